"""Loading runs from tagged text files, exporting bags as text, and the catalogue of what sequences a folder has."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import temporal
from wayfold.sources import bag, messages, text


def tagged(spec: str) -> tuple[str | None, str]:
    """(frame, file) of ``FRAME=FILE``; without a frame it is the base. Frames lose a leading ``/``."""
    frame, equals, path = spec.partition("=")
    return (frame.strip().removeprefix("/"), path.strip()) if equals else (None, spec.strip())


def _read(spark: SparkSession, specs: Sequence[str], read, frames: set[str] | None) -> DataFrame | None:
    out = None
    for k, spec in enumerate(specs):
        frame, path = tagged(spec)
        if frame is not None and frames is None:
            raise ValueError(f"{spec} needs a rig to know its frame")
        if frame is not None and frame not in frames:
            raise ValueError(f"no frame {frame} in the rig")
        part = read(spark, path).withColumns({"frame": F.lit(frame), "file": F.lit(k)})
        out = part if out is None else out.unionByName(part)
    return out


def loaded(spark: SparkSession, imus: Sequence[str] = (), scans: Sequence[str] = (), odometry: Sequence[str] = (), rig: DataFrame | None = None) -> DataFrame:
    """(kind, kind_rank, stamp_ns, frame, file, body) of sensors in text files, each given as ``FILE`` or ``FRAME=FILE``.

    Many files make one stream: sorted by (stamp_ns, kind_rank, file) it is merged stably. A null frame is the base; a named one
    must be in ``rig`` (frame, depth, pose), whose pose is joined as ``pose``. Odometry is told at the base. ``body`` has a struct by kind.
    """
    frames = None if rig is None else {r.frame for r in rig.select("frame").collect()}  # tens of frames
    if any(tagged(o)[0] for o in odometry):
        raise ValueError("odometry is told at the base frame")
    streams = {"imu": _read(spark, imus, text.read_imu, frames), "odometry": _read(spark, odometry, text.read_trajectory, frames), "scan": _read(spark, scans, text.read_scans, frames)}
    known = {k: s for k, s in streams.items() if s is not None}
    if not known:
        raise ValueError("no sensor files are given")
    bodies = {k: F.struct(*[c for c in s.columns if c not in ("stamp_ns", "frame", "file")]) for k, s in known.items()}
    kinds = {k: s.select(bodies[k].alias("b")).schema["b"].dataType for k, s in known.items()}
    parts = []
    for kind, s in known.items():
        body = F.struct(*[(bodies[k] if k == kind else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()])
        parts.append(s.select(F.lit(kind).alias("kind"), "stamp_ns", F.col("frame").cast("string").alias("frame"), "file", body.alias("body")))
    out = temporal.merge_streams(parts).select("kind", "kind_rank", "stamp_ns", "frame", "file", "body")
    return out if rig is None else out.join(F.broadcast(rig.select("frame", "pose")), "frame", "left").select(*out.columns, "pose")


def exported(spark: SparkSession, path: str, out: str, imu: str | None = None, scan: str | None = None) -> None:
    """A bag's inertial samples and scans as text, in ``out``/imu and ``out``/scan, from one pass over each topic; see ``text``."""
    if imu is None and scan is None:
        raise ValueError("no topic is given")
    if imu is not None:
        text.write_imu(messages.read_imu(spark, path, imu), f"{out}/imu")
    if scan is not None:
        text.write_scans(messages.read_scans(spark, path, scan), f"{out}/scan")


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: (path) -> (path, topics): a bag's topics with their types, from its index alone."""
    for batch in batches:
        paths = batch.column(0).to_pylist()
        found = [[{"topic": t, "type": k} for t, k in sorted(set(bag.index(re.sub("^file:/+", "/", p))[0].values()))] for p in paths]
        kind = pa.list_(pa.struct([("topic", pa.string()), ("type", pa.string())]))
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(found, kind)], ["path", "topics"])


def sequences(spark: SparkSession, root: str) -> DataFrame:
    """(sequence, bag, truth, duration_s, imus, scans, depths): what each folder below ``root`` has to run on.

    A sequence is a folder with a bag, a ground truth (``groundtruth.tum``) or both. Bags are probed by their index, many at once;
    the sensors are lists of topics, empty where the bag lacks them, so systems that need them can be left out. The duration is that of
    the ground truth, null without one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")  # names only
    of = lambda c: F.element_at(F.split(c, "/"), -2)
    bags = files.where(F.col("path").endswith(".bag")).groupBy(of(F.col("path")).alias("sequence")).agg(F.min("path").alias("path"))
    probed = bags.select("path").repartition(8).mapInArrow(_probed, "path string, topics array<struct<topic:string,type:string>>")
    having = lambda kind, part="": F.transform(F.filter("topics", lambda t: (t["type"] == kind) & t["topic"].contains(part)), lambda t: t["topic"])
    known = bags.join(probed, "path").select("sequence", F.col("path").alias("bag"), having(messages.IMU).alias("imus"), having(messages.SCAN).alias("scans"), having(messages.IMAGE, "depth").alias("depths"))
    none = F.array().cast("array<string>")
    truths = files.where(F.col("path").endswith("/groundtruth.tum"))
    lasts = spark.createDataFrame([], "sequence string, truth string, duration_s double")
    if not truths.isEmpty():
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "groundtruth.tum").text(root).select(F.col("_metadata.file_path").alias("truth"), F.trim("value").alias("line")).where("line <> '' and line not like '#%'")
        stamp = F.element_at(F.split("line", "\\s+"), 1).cast("decimal(38,9)")
        lasts = lines.groupBy("truth").agg((F.max(stamp) - F.min(stamp)).cast("double").alias("duration_s")).select(of(F.col("truth")).alias("sequence"), "truth", "duration_s")
    met = known.join(lasts, "sequence", "full")
    return met.select("sequence", "bag", "truth", "duration_s", *[F.coalesce(c, none).alias(c) for c in ("imus", "scans", "depths")])

