"""Cutting the lineage of tables that a next round of work reads more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the checkpoint folder and read back: survives lost executors, and leaves no plan behind.

    The folder is the session's ``spark.checkpoint.dir``. A local session that names none, as in tests, gets a temporary
    one; on a cluster that is an error. The table is deleted when the application ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="wayfold-")
        context.setCheckpointDir(place)
    path = f"{place.rstrip('/')}/wayfold-cut-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
