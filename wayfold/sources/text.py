"""Text formats of sensor logs, read and written as DataFrames.

Stamps are parsed exactly (never through a double). Comments (#) and blank lines are skipped; a row with a wrong
number of fields or a field that is no number stops the job and names the file, line text and field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.time import format_stamp, parse_stamp

IMU = ("gx", "gy", "gz", "ax", "ay", "az")
POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def _lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    text = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    text = text.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return text.withColumn("f", F.filter(F.split("line", separator), lambda x: x != ""))


def _fail(what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.col("file"), F.lit(": "), F.col("line")))


def _fields(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    fine = F.when(F.size("f") == len(names) + 1, F.col("f")).otherwise(_fail(f"expected {len(names) + 1} fields").cast("array<string>"))
    checked = lines.withColumn("f", fine)
    number = lambda k, name: F.coalesce(F.col("f")[k].try_cast("double"), _fail(f"field {name} is no number").cast("double")).alias(name)
    stamp = F.coalesce(parse_stamp(F.col("f")[0]), _fail("no stamp").cast("long")).alias("stamp_ns")
    return checked.select(stamp, *[number(k + 1, n) for k, n in enumerate(names)])


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """``t gx gy gz ax ay az``, separated by commas, blanks or both."""
    return _fields(_lines(spark, path, "[,\\s]+"), IMU)


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """``t tx ty tz qx qy qz qw``; quaternions are scaled to length one."""
    rows = _fields(_lines(spark, path, "\\s+"), POSE)
    n = F.sqrt(sum(F.col(c) * F.col(c) for c in POSE[3:]))
    return rows.withColumns({c: F.col(c) / n for c in POSE[3:]})


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """``t angle_min angle_increment range_min range_max n r0 ...``; nan and inf are kept, n must be right."""
    lines = _lines(spark, path, "[,\\s]+")
    head = ("angle_min", "angle_increment", "range_min", "range_max")
    n = F.col("f")[5].try_cast("int")
    fine = F.when((F.size("f") >= 6) & (n == F.size("f") - 6), F.col("f")).otherwise(_fail("the number of ranges is wrong").cast("array<string>"))
    value = lambda x: F.when(F.lower(x) == "inf", F.lit(float("inf"))).when(F.lower(x) == "-inf", F.lit(float("-inf"))).when(F.lower(x) == "nan", F.lit(float("nan"))).otherwise(F.coalesce(x.try_cast("double"), _fail("a range is no number").cast("double")))
    checked = lines.withColumn("f", fine)
    return checked.select(
        F.coalesce(parse_stamp(F.col("f")[0]), _fail("no stamp").cast("long")).alias("stamp_ns"),
        *[F.coalesce(F.col("f")[k + 1].try_cast("double"), _fail(f"field {c} is no number").cast("double")).alias(c) for k, c in enumerate(head)],
        F.transform(F.slice("f", F.lit(7), F.size("f") - 6), lambda x: value(x).cast("float")).alias("ranges"),
    )


def read_euroc_imu(spark: SparkSession, path: str) -> DataFrame:
    """``ts_ns,wx,wy,wz,ax,ay,az``: stamps are whole nanoseconds."""
    f = _lines(spark, path, ",")
    return f.select(F.col("f")[0].cast("long").alias("stamp_ns"), *[F.col("f")[k + 1].cast("double").alias(c) for k, c in enumerate(IMU)])


def read_euroc_truth(spark: SparkSession, path: str) -> DataFrame:
    """``ts_ns,px,py,pz,qw,qx,qy,qz,...``: the scalar part comes first and is put last."""
    f = _lines(spark, path, ",")
    order = dict(zip(POSE, (1, 2, 3, 5, 6, 7, 4), strict=True))
    return f.select(F.col("f")[0].cast("long").alias("stamp_ns"), *[F.col("f")[k].cast("double").alias(c) for c, k in order.items()])


def _write(rows: DataFrame, line: Column, path: str, header: str) -> None:
    spark = rows.sparkSession
    ordered = rows.select("stamp_ns", line.alias("value"))
    first = spark.createDataFrame([(-(1 << 63), header)], "stamp_ns long, value string")
    first.unionByName(ordered).repartitionByRange("stamp_ns").sortWithinPartitions("stamp_ns").select("value").write.mode("overwrite").text(path)


def write_imu(imu: DataFrame, path: str) -> None:
    """Files whose names sort as their stamps do; nine decimals."""
    _write(imu, F.concat_ws(" ", format_stamp(F.col("stamp_ns")), *[F.format_string("%.9f", c) for c in IMU]), path, "# t gx gy gz ax ay az")


def write_trajectory(poses: DataFrame, path: str) -> None:
    _write(poses, F.concat_ws(" ", format_stamp(F.col("stamp_ns")), *[F.format_string("%.9f", c) for c in POSE]), path, "# t tx ty tz qx qy qz qw")


def write_scans(scans: DataFrame, path: str) -> None:
    angles = [F.format_string("%.9f", c) for c in ("angle_min", "angle_increment")]
    limits = [F.format_string("%.4f", c) for c in ("range_min", "range_max")]
    shown = F.transform("ranges", lambda r: F.when(F.isnan(r), "nan").when(r == float("inf"), "inf").when(r == float("-inf"), "-inf").otherwise(r.cast("string")))
    _write(scans, F.concat_ws(" ", format_stamp(F.col("stamp_ns")), *angles, *limits, F.size("ranges").cast("string"), F.array_join(shown, " ")), path, "# t angle_min angle_increment range_min range_max n ranges")


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """(ix, iy, iz, tsdf, weight, voxel) of voxel dumps: a 20-byte head, then 20 bytes a voxel, little-endian."""
    import numpy as np
    import pandas as pd

    record = np.dtype([("ix", "<i4"), ("iy", "<i4"), ("iz", "<i4"), ("tsdf", "<f4"), ("weight", "<f4")])

    def parse(frames):
        for f in frames:
            for raw in f["content"]:
                if raw[:4] != b"STSD" or int.from_bytes(raw[4:8], "little") != 1:
                    raise ValueError("not a voxel dump of version 1")
                size, n = float(np.frombuffer(raw[8:16], "<f8")[0]), int.from_bytes(raw[16:24], "little")
                if len(raw) != 24 + n * record.itemsize:
                    raise ValueError(f"{n} voxels announced, {(len(raw) - 24) / record.itemsize} there")
                yield pd.DataFrame(np.frombuffer(raw[24:], record)).assign(voxel=size)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "ix int, iy int, iz int, tsdf float, weight float, voxel double")
