"""The driver's tables read as sensor logs: topics of `events`, scans of `embeddings`, runs of `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.time import stamp_of


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, stamp_ns, run_id, topic, value, k)."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", stamp_of(F.col("ts")).alias("stamp_ns"), F.col("user_id").alias("run_id"), F.col("event_type").alias("topic"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


LOG = """e AS (SELECT event_id, epoch_us(ts) * 1000 AS stamp_ns, user_id AS run_id, event_type AS topic, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as planar points (x, y, z): value and k scaled to metres."""
    return log(spark, sf_dir).withColumns({"x": F.col("value") / 50.0, "y": F.col("k") / 10.0, "z": F.col("k") % 7 / 4.0})


PLANAR = LOG + """, p AS (SELECT *, value / 50.0::DOUBLE AS x, k / 10.0::DOUBLE AS y, (k % 7) / 4.0::DOUBLE AS z FROM e)"""


def beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans: each embedding's components, scaled, are the ranges of its 64 beams."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scan"), F.transform("embedding", lambda r: r.cast("double") * 40).alias("ranges"))
