"""Run configurations, and the merged stream of sensors that one describes."""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import get_args, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import rig, temporal
from wayfold.sources import files, messages


@dataclass
class Scan:
    topic: str


@dataclass
class Imu:
    topic: str | None = None
    gyro_topic: str | None = None
    accel_topic: str | None = None

    def __post_init__(self):
        split = self.gyro_topic, self.accel_topic
        if (self.topic is None) == (split == (None, None)) or split.count(None) == 1:
            raise ValueError("an inertial sensor has either a topic or both gyro_topic and accel_topic")


@dataclass
class Odometry:
    topic: str


@dataclass
class Camera:
    topic: str
    camera_info: str | None = None
    color: str | None = None
    target_spacing: float = 0.05
    min_stride: int = 2
    max_points: int = 20_000
    min_range: float = 0.3
    max_range: float = 6.0
    every_nth: int = 3

    def __post_init__(self):
        if self.camera_info is None:  # beside the image, as cameras publish it
            head, slash, _ = self.topic.rpartition("/")
            self.camera_info = f"{head if slash else self.topic}/camera_info"


@dataclass
class Sensors:
    scans: list[Scan] = field(default_factory=list)
    imus: list[Imu] = field(default_factory=list)
    depth: list[Camera] = field(default_factory=list)
    odometry: list[Odometry] = field(default_factory=list)


@dataclass
class Rig:
    source: str = "identity"
    urdf: str | None = None
    base_frame: str = "base_link"

    def __post_init__(self):
        if self.source not in ("identity", "bag", "urdf"):
            raise ValueError(f"no rig source {self.source}")
        if self.source == "urdf" and self.urdf is None:
            raise ValueError("a rig from a robot description needs its file")


@dataclass
class Masking:
    model: str
    conf: float = 0.2
    dilate_px: int = 8
    classes: str | list[int] = "dynamic"


@dataclass
class Run:
    rig: Rig = field(default_factory=Rig)
    sensors: Sensors = field(default_factory=Sensors)
    masking: Masking | None = None


def parsed(kind: type, value: dict | None):
    """A dataclass from a mapping; keys that it doesn't have, and missing ones that it needs, are errors."""
    value, hints = value or {}, get_type_hints(kind)
    extra = value.keys() - hints.keys()
    lacking = {f.name for f in fields(kind) if f.default is MISSING and f.default_factory is MISSING} - value.keys()
    if extra or lacking:
        raise ValueError(f"{kind.__name__}: unknown {sorted(extra)}, missing {sorted(lacking)}")
    out = {}
    for k, v in value.items():
        inner = next((t for t in (hints[k], *get_args(hints[k])) if is_dataclass(t)), None)
        out[k] = v if inner is None else [parsed(inner, x) for x in v] if isinstance(v, list) else parsed(inner, v)
    return kind(**out)


def load(path: str) -> Run:
    """The configuration of a run from a YAML file."""
    import yaml

    with open(path) as f:
        return parsed(Run, yaml.safe_load(f))


def frames(spark: SparkSession, config: Run, path: str) -> DataFrame | None:
    """(frame, depth, pose) of the rig; None where all sensors sit in the base frame."""
    if config.rig.source == "identity":
        return None
    edges = messages.read_static_transforms(spark, path) if config.rig.source == "bag" else files.read_rig(spark, config.rig.urdf)
    return rig.poses(edges, config.rig.base_frame)


def assembled(spark: SparkSession, config: Run, path: str) -> DataFrame:
    """(kind, kind_rank, stamp_ns, place, topic, frame, body): all sensors of a run in one stream.

    ``body`` is a struct with a field for each kind, of which a row fills its own: imu, odometry, scan and, where the run has depth
    cameras, cloud. Sorted by (stamp_ns, kind_rank, place) the streams are merged stably: inertial samples, odometry, scans,
    clouds. All topics but those of depth cameras are read in one pass. Split inertial sensors are merged at the
    stamps of the gyro. With a rig, ``pose`` is that of the frame, and a frame that it doesn't have is an error.
    """
    s = config.sensors
    split = [i for i in s.imus if i.topic is None]
    topics = {i.topic: "imu" for i in s.imus if i.topic is not None} | {t: "imu" for i in split for t in (i.gyro_topic, i.accel_topic)}
    topics |= {o.topic: "odometry" for o in s.odometry} | {c.topic: "scan" for c in s.scans}
    if not topics and not s.depth:
        raise ValueError("the configuration names no sensor")
    kinds = ["imu", "odometry", "scan"]
    out = None
    if topics:
        all_ = messages.read_streams(spark, path, topics)
        halves = {t for i in split for t in (i.gyro_topic, i.accel_topic)}
        out = all_.where(~F.col("topic").isin(sorted(halves))) if halves else all_
        for i in split:
            gyro, accel = (all_.where(F.col("topic") == t).withColumn("run", F.lit(0)) for t in (i.gyro_topic, i.accel_topic))
            sides = accel.select("run", "stamp_ns", "place", *[F.col(f"imu.{c}").alias(c) for c in ("ax", "ay", "az")])
            met = temporal.interpolated_at(gyro, sides, ["run"], "stamp_ns", "place", "place", {"ax": "ax", "ay": "ay", "az": "az"})
            imu = F.struct("imu.gx", "imu.gy", "imu.gz", "ax", "ay", "az").alias("imu")
            out = out.unionByName(met.select("topic", "place", "stamp_ns", "frame", "kind", imu, "odometry", "scan"))
    for c in s.depth:
        cfg = messages.Depth(c.target_spacing, c.min_stride, c.max_points, c.min_range, c.max_range, c.every_nth)
        clouds = messages.read_depth_clouds(spark, path, c.topic, c.camera_info, c.color, cfg)
        body = [n for n in clouds.columns if n not in ("topic", "place", "stamp_ns", "frame")]
        part = clouds.select(F.lit(c.topic).alias("topic"), "place", "stamp_ns", "frame", F.lit("cloud").alias("kind"), F.struct(*body).alias("cloud"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    kinds = [k for k in (*kinds, "cloud") if k in out.columns]
    rank = F.array_position(F.array(*[F.lit(k) for k in ("imu", "odometry", "scan", "cloud")]), F.col("kind")).cast("int") - 1
    out = out.select("kind", rank.alias("kind_rank"), "stamp_ns", "place", "topic", F.regexp_replace("frame", "^/", "").alias("frame"), F.struct(*kinds).alias("body"))
    known = frames(spark, config, path)
    if known is None:
        return out
    met = out.join(F.broadcast(known.select("frame", "pose")), "frame", "left")  # one row a frame of the rig
    unknown = F.raise_error(F.concat(F.lit("no frame in the rig: "), F.col("frame"))).cast(known.schema["pose"].dataType)
    return met.withColumn("pose", F.when((F.col("kind") == "odometry") | F.col("pose").isNotNull(), F.col("pose")).otherwise(unknown))
