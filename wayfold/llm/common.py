"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that leave the JVM for a Python worker at once, unless the session sets its own.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows with long texts then reach Python in batches that a worker can hold beside others."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name).removesuffix("b") == str(64 << 20):  # the default
        conf.set(name, str(BATCH_BYTES))
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: ``spark.checkpoint.dir``.

    A local session that names none, as in tests, gets a temporary folder for its time; on a cluster that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def _file(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/wayfold-{tag}-{uuid.uuid4().hex}"
    fs, where = _file(spark, path)
    fs.deleteOnExit(where)
    return path


def stash(df: DataFrame, tag: str, rows: int | None = None, each: int = 25_000) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Where the number of ``rows`` is known, tasks take about ``each`` of them, so that a small table isn't written
    as one tiny file per shuffle partition.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stashed = path
    return found


def discard(*stashed: DataFrame | None) -> None:
    """Delete stashed tables that nothing will read again."""
    for df in stashed:
        if df is not None:
            fs, where = _file(df.sparkSession, df.stashed)
            fs.delete(where, True)


def crc_bucket(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 marks the held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def slices(batches, rows: int = 1000, column: int | None = None, size: int = 4 << 20):
    """The same rows in smaller batches, so that their Python copies stay small.

    With a ``column`` of texts, a batch ends before their bytes pass ``size``; a longer text stands alone.
    """
    for batch in batches:
        if column is None:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, end - start)
            start = end


def texts_of(column: pa.Array):
    """The texts of a column one after another, so that only one of them is a Python string at a time."""
    for x in column:
        yield x.as_py()


def give_back() -> None:
    """Free memory of this worker goes back to the system: a worker waits for its next task beside others at work."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def frugal(task):
    """``task``, which maps batches, giving its memory back when it ends."""

    def mapped(batches):
        yield from task(batches)
        give_back()

    return mapped


def planes(values: np.ndarray) -> bytes:
    """Byte planes of sorted integers: the leading planes then compress to almost nothing."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    """Inverse of :func:`planes`."""
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()
