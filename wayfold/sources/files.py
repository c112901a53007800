"""Small files around a run: rigs, voxel dumps, metrics, reports and published results."""

from __future__ import annotations

import math
import struct
import xml.etree.ElementTree as ET
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geometry as geo


def read_rig(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, fixed, pose) of the joints of a robot description; a joint without an origin is at its parent's."""
    joints = []
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    for joint in ET.fromstring(text).iter("joint"):
        ends = joint.find("parent"), joint.find("child")
        if None in ends:
            continue  # transmissions name joints, too
        origin = joint.find("origin")
        place = {k: [float(x) for x in (origin.get(k) if origin is not None and origin.get(k) else "0 0 0").split()] for k in ("xyz", "rpy")}
        joints.append((ends[0].get("link"), ends[1].get("link"), joint.get("type") == "fixed", *place["xyz"], *place["rpy"]))
    df = spark.createDataFrame(joints, "parent string, child string, fixed boolean, x double, y double, z double, roll double, pitch double, yaw double")
    pose = geo.pose(geo.vector(F.col("x"), F.col("y"), F.col("z")), geo.from_rpy(F.col("roll"), F.col("pitch"), F.col("yaw")))
    return df.select("parent", "child", "fixed", pose.alias("pose"))


def write_voxels(voxels: DataFrame, path: str, voxel: float) -> None:
    """One voxel dump of the observed voxels (ix, iy, iz, tsdf, weight), ordered by index; see ``text.read_voxels``.

    The rows pass through the driver one partition at a time, to a file of any store that Spark writes to.
    """
    spark = voxels.sparkSession
    seen = voxels.where("weight > 0").select("ix", "iy", "iz", "tsdf", "weight")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(b"STSD" + struct.pack("<IdQ", 1, voxel, seen.count())))
        part: list[bytes] = []
        for r in seen.orderBy("ix", "iy", "iz").toLocalIterator():
            part.append(struct.pack("<3i2f", *r))
            if len(part) == 50_000:
                out.write(bytearray(b"".join(part)))
                part = []
        out.write(bytearray(b"".join(part)))
    finally:
        out.close()


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON line a run, which keeps fields that are null."""
    metrics.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def markdown(table: DataFrame, columns: Sequence[str], order: Sequence[str], digits: int = 4) -> str:
    """A report's table; figures that are missing, not numbers or infinite show as a dash. Reports have some hundred rows."""

    def shown(v) -> str:
        if v is None or isinstance(v, float) and not math.isfinite(v):
            return "-"
        return f"{v:.{digits}g}" if isinstance(v, float) else str(v)

    rows = table.select(*columns).orderBy(*order).collect()
    lines = [f"| {' | '.join(columns)} |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *(f"| {' | '.join(map(shown, r))} |" for r in rows)]) + "\n"


def read_published(spark: SparkSession, path: str, block: str) -> DataFrame:
    """(method, scene, value, name) of published results: a list of entries, each with maps of scenes to values."""
    raw = spark.read.option("multiLine", True).json(path)
    entries = raw.select(F.explode(block).alias("e")).select("e.*")
    maps = [f.name for f in entries.schema if f.dataType.typeName() == "struct"]
    name = next(f.name for f in entries.schema if f.dataType.typeName() == "string")
    out = None
    for m in maps:
        kinds = [f.name for f in entries.schema[m].dataType if f.dataType.typeName() in ("double", "long")]
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("scene"), F.col(f"{m}.`{k}`").cast("double").alias("value")) for k in kinds])).alias("p")
        part = entries.select(F.col(name).alias("method"), pairs).select("method", "p.scene", "p.value", F.lit(m).alias("name")).where("value is not null")
        out = part if out is None else out.unionByName(part)
    return out
