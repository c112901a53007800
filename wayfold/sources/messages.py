"""Typed tables of the messages in a bag: inertial samples, scans, odometry, transforms, camera data and depth clouds.

Bodies are decoded in Arrow batches, one message to one row or several. ``place`` orders rows as the file has them.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wayfold.operators import temporal
from wayfold.sources import bag

#: Names of message types, as the format has them.
IMU, SCAN, ODOMETRY, TRANSFORMS, CAMERA, IMAGE = "sensor_msgs/Imu", "sensor_msgs/LaserScan", "nav_msgs/Odometry", "tf2_msgs/TFMessage", "sensor_msgs/CameraInfo", "sensor_msgs/Image"
#: Channels of red, green and blue, and bytes a pixel, of the encodings.
COLOURS = {"rgb8": ((0, 1, 2), 3), "bgr8": ((2, 1, 0), 3), "rgba8": ((0, 1, 2), 4), "bgra8": ((2, 1, 0), 4)}
DEPTHS = {"16UC1": ("<u2", 1e-3), "mono16": ("<u2", 1e-3), "32FC1": ("<f4", 1.0)}


class Body:
    """A message body, read from its beginning on; reading beyond its end raises ValueError."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("a message is cut off")
        self.at += n
        return self.raw[self.at - n : self.at]

    def numbers(self, kinds: str) -> tuple:
        return struct.unpack("<" + kinds, self.take(struct.calcsize("<" + kinds)))

    def text(self) -> str:
        return self.take(self.numbers("I")[0]).decode(errors="replace")

    def header(self) -> tuple[int, str]:
        _, seconds, nanos = self.numbers("III")
        return seconds * 1_000_000_000 + nanos, self.text()


def transforms(raw: bytes) -> list[tuple]:
    """(parent, child, tx, ty, tz, qx, qy, qz, qw) of each transform; quaternions are scaled to length one."""
    body = Body(raw)
    (n,) = body.numbers("I")
    if n * 60 > len(raw):
        raise ValueError("more transforms announced than there are")
    out = []
    for _ in range(n):
        _, parent = body.header()
        child, t, q = body.text(), body.numbers("3d"), body.numbers("4d")
        size = math.sqrt(sum(c * c for c in q))
        out.append((parent, child, *t, *(c / size if size else float(k == 3) for k, c in enumerate(q))))
    return out


def camera_info(raw: bytes) -> tuple:
    """(stamp_ns, frame, width, height, fx, fy, cx, cy); the distortion is passed over."""
    body = Body(raw)
    stamp, frame = body.header()
    height, width = body.numbers("II")
    body.text()
    (n,) = body.numbers("I")
    body.take(8 * n)
    k = body.numbers("9d")
    return stamp, frame, width, height, k[0], k[4], k[2], k[5]


def image(raw: bytes) -> tuple:
    """(stamp_ns, frame, width, height, encoding, step, pixels)."""
    body = Body(raw)
    stamp, frame = body.header()
    height, width = body.numbers("II")
    encoding = body.text()
    body.take(1)
    step, n = body.numbers("II")
    return stamp, frame, width, height, encoding, step, body.take(n)


def colours(width: int, height: int, encoding: str, step: int, pixels: bytes) -> np.ndarray:
    """(height, width, 3) red, green and blue of an image."""
    if encoding not in COLOURS:
        raise ValueError(f"colours encoded as {encoding} are not supported")
    order, size = COLOURS[encoding]
    return _rows(width, height, step, pixels, size).reshape(height, width, size)[:, :, list(order)]


def depths(width: int, height: int, encoding: str, step: int, pixels: bytes) -> np.ndarray:
    """(height, width) depths in metres."""
    if encoding not in DEPTHS:
        raise ValueError(f"depths encoded as {encoding} are not supported")
    kind, scale = DEPTHS[encoding]
    return np.ascontiguousarray(_rows(width, height, step, pixels, np.dtype(kind).itemsize)).view(kind).astype(np.float64) * scale


def _rows(width: int, height: int, step: int, pixels: bytes, size: int) -> np.ndarray:
    if step < width * size or len(pixels) < step * height:
        raise ValueError("an image has fewer pixels than it announces")
    return np.frombuffer(pixels, np.uint8)[: step * height].reshape(height, step)[:, : width * size]


def decoded(messages: DataFrame, decode: Callable[[bytes], Sequence[tuple] | tuple], columns: str, many: bool = False) -> DataFrame:
    """(topic, place, columns): each message's body decoded to a row, or with ``many`` to as many as it has."""
    schema = StructType.fromDDL(f"topic string, place long, {columns}")
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for topic, place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = decode(data.as_py())
                out += [(topic, place, *r) for r in (found if many else [found])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(arrow), arrow, strict=True)], schema=arrow)

    place = F.shiftleft(F.col("chunk").cast("long"), 32) + F.col("seq")
    return messages.select("topic", place.alias("place"), "data").mapInArrow(rows, schema)


def opened(spark: SparkSession, path: str, topics: Sequence[str]) -> DataFrame:
    """The raw messages of some topics; chunks without them are never read."""
    bag.register(spark)
    return spark.read.format("bag").option("topics", ",".join(topics)).load(path)


def topics_of(path: str) -> dict[str, str]:
    """Topics with their types, from the index alone; of several types the last one holds."""
    return dict(sorted(bag.index(path)[0].values()))


def _resolved(path: str, topic: str | None, kind: str) -> str:
    return bag.resolved(bag.index(path)[0], topic, kind)


#: kind -> (message type, decoder, columns after stamp and frame) of the sensors that become streams.
STREAMS = {
    "imu": (IMU, bag.imu, "gx double, gy double, gz double, ax double, ay double, az double"),
    "odometry": (ODOMETRY, bag.odometry, "child string, tx double, ty double, tz double, qx double, qy double, qz double, qw double"),
    "scan": (SCAN, bag.scan, "angle_min float, angle_increment float, range_min float, range_max float, ranges array<float>"),
}


def read_streams(spark: SparkSession, path: str, topics: dict[str, str]) -> DataFrame:
    """(topic, place, stamp_ns, frame, kind, imu, odometry, scan) of several topics (topic -> kind) in one pass over the file.

    Each message is decoded once, by the kind of its topic, into that kind's struct; the other structs are null. A topic
    that the file lacks, or has with another type, is an error.
    """
    connections = bag.index(path)[0]
    for topic, kind in topics.items():
        bag.resolved(connections, topic, STREAMS[kind][0])
    structs = ", ".join(f"{k} struct<{', '.join(c.replace(' ', ': ', 1) for c in columns.split(', '))}>" for k, (_, _, columns) in STREAMS.items())
    schema = StructType.fromDDL(f"topic string, place long, stamp_ns long, frame string, kind string, {structs}")
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in arrow]
            for topic, place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                kind = topics[topic]
                stamp, frame, *found = STREAMS[kind][1](data.as_py())
                bodies = [dict(zip(schema[k].dataType.names, found, strict=True)) if k == kind else None for k in STREAMS]
                for column, value in zip(out, (topic, place, stamp, frame, kind, *bodies), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    place = F.shiftleft(F.col("chunk").cast("long"), 32) + F.col("seq")
    return opened(spark, path, sorted(topics)).select("topic", place.alias("place"), "data").mapInArrow(rows, schema)


def _one(spark: SparkSession, path: str, topic: str | None, kind: str) -> DataFrame:
    name, decode, columns = STREAMS[kind]
    return decoded(opened(spark, path, [_resolved(path, topic, name)]), decode, f"stamp_ns long, frame string, {columns}")


def read_imu(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """(topic, place, stamp_ns, frame, gx, gy, gz, ax, ay, az); without a topic, the only one of its type."""
    return _one(spark, path, topic, "imu")


def read_scans(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    return _one(spark, path, topic, "scan")


def read_odometry(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    return _one(spark, path, topic, "odometry")


def read_static_transforms(spark: SparkSession, path: str, topic: str = "/tf_static") -> DataFrame:
    """(parent, child, pose): the first transform of each pair of frames."""
    columns = "parent string, child string, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
    found = decoded(opened(spark, path, [topic]), transforms, columns, many=True)
    first = temporal.first_wins(found.drop("topic"), ["parent", "child"], ["place"])
    return first.select("parent", "child", F.struct("tx", "ty", "tz", "qx", "qy", "qz", "qw").alias("pose"))


def first_frames(df: DataFrame) -> DataFrame:
    """(topic, frame): the frame that each topic's first message names."""
    return df.groupBy("topic").agg(F.min_by("frame", "place").alias("frame"))


@dataclass(frozen=True)
class Depth:
    """How a depth image becomes points: their spacing, the grid's stride, their number, the range that counts, and which frames."""

    spacing: float = 0.05
    stride: int = 2
    points: int = 20_000
    near: float = 0.3
    far: float = 6.0
    every: int = 3
    pairing_ns: int = 50_000_000


def cloud(z: np.ndarray, k: tuple[float, float, float, float], cfg: Depth, colour: np.ndarray | None = None, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Points (n, 3) of a depth image, with their colours: near surfaces are thinned more, masked pixels left out.

    Images of other sizes are looked up in proportion. Beyond ``cfg.points`` every n-th point stays.
    """
    fx, fy, cx, cy = k
    v, u = (i.ravel() for i in np.mgrid[0 : z.shape[0] : cfg.stride, 0 : z.shape[1] : cfg.stride])
    depth = z[v, u]
    with np.errstate(invalid="ignore", divide="ignore"):
        fine = np.isfinite(depth) & (depth >= cfg.near) & (depth <= cfg.far)
        times = np.maximum(cfg.spacing * fx / depth / cfg.stride, 1.0)
    u, v, depth, times = u[fine], v[fine], depth[fine], times[fine]
    step = cfg.stride * 2 ** (np.frexp(times)[1] - 1).astype(np.int64)  # whole powers exactly
    keep = (u % step == 0) & (v % step == 0)
    pick = lambda other: (np.minimum(v * other.shape[0] // z.shape[0], other.shape[0] - 1), np.minimum(u * other.shape[1] // z.shape[1], other.shape[1] - 1))
    if mask is not None:
        keep &= ~mask[pick(mask)]
    u, v, depth = u[keep], v[keep], depth[keep]
    points = np.stack([(u - cx) / fx * depth, (v - cy) / fy * depth, depth], 1)
    paint = None if colour is None else colour[pick(colour)]
    every = max(1, -(-len(points) // cfg.points))
    return points[::every], None if paint is None else paint[::every]


def read_depth_clouds(spark: SparkSession, path: str, depth: str, info: str, colour: str | None = None, cfg: Depth = Depth()) -> DataFrame:
    """(place, stamp_ns, frame, points array of (x, y, z), colours array of (r, g, b) or null).

    Every n-th depth image is used, numbered as the file has them. The first camera info of the topic holds for all; images before
    it wait for it, 64 of them at most. The colour image is the one delivered last, if its stamp is within the pairing time.
    Raises if the topic has no camera info.
    """
    columns = "stamp_ns long, frame string, width int, height int, encoding string, step int, pixels binary"
    infos = decoded(opened(spark, path, [info]), camera_info, "stamp_ns long, frame string, width int, height int, fx double, fy double, cx double, cy double").withColumn("g", F.lit(0))
    if infos.isEmpty():
        raise ValueError(f"no camera info in {info}")
    # frames are chosen, and paired with what they need, by their places alone; only then images are joined and decoded
    place = F.shiftleft(F.col("chunk").cast("long"), 32) + F.col("seq")
    raw = opened(spark, path, [depth])
    kept = temporal.every_nth(raw.select(F.lit(0).alias("g"), place.alias("place"), "stamp_ns"), cfg.every, ["g"], ["place"])
    kept = temporal.with_first_info(kept, infos.select("g", "place", "fx", "fy", "cx", "cy"), ["g"], ["place"], ["fx", "fy", "cx", "cy"])
    frames = decoded(raw.withColumn("place", place).join(kept.select("place"), "place", "left_semi"), image, columns).drop("topic")
    met = frames.join(kept.select("place", "fx", "fy", "cx", "cy"), "place")
    paint = ["c_width", "c_height", "c_encoding", "c_step", "c_pixels"]
    if colour is None:
        met = met.withColumns({c: F.lit(None).cast("binary" if c == "c_pixels" else "string" if c == "c_encoding" else "int") for c in paint})
    else:
        images = decoded(opened(spark, path, [colour]), image, columns)
        seen = images.select(F.lit(0).alias("g"), "place", F.col("stamp_ns").alias("at"), F.col("place").alias("image"))
        pairs = temporal.latest_before(frames.select(F.lit(0).alias("g"), "place", "stamp_ns"), seen, ["g"], "place", "place", "image", ["image", "at"])
        near = pairs.where(F.abs(F.col("stamp_ns") - F.col("at")) < cfg.pairing_ns).select("place", "image")
        used = images.select(F.col("place").alias("image"), *[F.col(c.removeprefix("c_")).alias(c) for c in paint])
        met = met.join(near.join(used, "image").drop("image"), "place", "left")

    def clouds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                seen = None if r["c_pixels"] is None else colours(r["c_width"], r["c_height"], r["c_encoding"], r["c_step"], r["c_pixels"])
                points, painted = cloud(depths(r["width"], r["height"], r["encoding"], r["step"], r["pixels"]), (r["fx"], r["fy"], r["cx"], r["cy"]), cfg, seen)
                three = lambda a, kind: pa.array([None if a is None else a.tolist()], pa.list_(pa.list_(kind)))
                yield pa.RecordBatch.from_arrays([pa.array([r["place"]]), pa.array([r["stamp_ns"]]), pa.array([r["frame"]]), three(points, pa.float64()), three(painted, pa.int32())], ["place", "stamp_ns", "frame", "points", "colours"])

    return met.mapInArrow(clouds, "place long, stamp_ns long, frame string, points array<array<double>>, colours array<array<int>>")
