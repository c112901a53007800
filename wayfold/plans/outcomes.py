"""What a folder of runs came to: trajectories against ground truth, with the metrics and logs that lie beside them.

A run's files share its tag, ``SEQUENCE.CONFIG``: ``TAG.tum`` (trajectory), ``TAG.metrics.json`` and ``TAG.log``. All runs
of a folder are scored together; what one of them lacks, or has broken, is null and leaves the others alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geometry as geo
from wayfold.functions.time import parse_stamp
from wayfold.operators import stats, temporal
from wayfold.sources.text import POSE

#: How logs tell the most memory used and the health of a run.
RSS = r"Maximum resident set size \(kbytes\): (\d+)"
HEALTH = r"health: (\d+) matched / (\d+) coasted / (\d+) skipped /\s+(\d+) degenerate; (\d+) submap hand-overs, (\d+) verified loop"
#: Poses are associated within 10 ms; relative errors are of 1 m of the run's way.
GATE_NS, DELTA = 10_000_000, 1.0
_METRICS = "real_time_factor double, latency_us struct<p99: double>, n_samples long"


def _tag(suffix: str) -> Column:
    name = F.col("_metadata.file_name")
    return F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("tag")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(tag, rtf, p99_us, events) of the metrics in a folder; a file that is no JSON gives nulls."""
    read = spark.read.schema(_METRICS).option("multiLine", "true").option("pathGlobFilter", "*.metrics.json").json(folder)
    found = read.select(_tag(".metrics.json"), F.col("real_time_factor").alias("rtf"), F.col("latency_us.p99").alias("p99_us"), F.col("n_samples").alias("events"))
    return found.dropDuplicates(["tag"])


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """(tag, rss_mb, matched, coasted, degenerate, submaps, loops) of the logs in a folder: the first line of each kind, null without one."""
    read = spark.read.option("pathGlobFilter", "*.log").text(folder, wholetext=True).select(_tag(".log"), "value")
    told = lambda pattern, k: F.regexp_extract("value", pattern, k).try_cast("long")
    health = {name: told(HEALTH, k) for name, k in (("matched", 1), ("coasted", 2), ("degenerate", 4), ("submaps", 5), ("loops", 6))}
    health["submaps"] = health["submaps"] + 1  # one more than there were hand-overs
    return read.select("tag", (told(RSS, 1) / 1024).alias("rss_mb"), *[c.alias(k) for k, c in health.items()])


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """(tag, broken, stamp_ns, tx ... qw): every line of every trajectory in a folder. ``broken`` lines have no eight numbers."""
    read = spark.read.option("pathGlobFilter", "*.tum").text(folder).select(_tag(".tum"), F.trim("value").alias("line"))
    f = read.where("line <> '' and line not like '#%'").withColumn("f", F.split("line", "\\s+"))
    rows = f.select("tag", F.size("f").alias("n"), parse_stamp(F.get("f", F.lit(0))).alias("stamp_ns"), *[F.get("f", F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate(POSE)])
    whole = (F.col("n") == len(POSE) + 1) & F.col("stamp_ns").isNotNull()
    for c in POSE:
        whole &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.withColumn("broken", ~F.coalesce(whole, F.lit(False))).drop("n")


def _relative(pairs: DataFrame) -> DataFrame:
    """(tag, rpe): how the ways between poses a metre of the estimate apart differ, root mean square."""
    ends = stats.arc_pairs(pairs, "tag", ["stamp_ns", "ref_stamp"], POSE[:3], DELTA, [*POSE[3:], *(f"ref_{c}" for c in POSE)])

    def way(prefix: str) -> Column:
        at = lambda end: [F.col(f"{end}_{prefix}{c}") for c in POSE]
        a, b = at("from"), at("to")
        q = geo.quaternion(*a[3:])
        return geo.rotate(geo.q_inverse(q), geo.vector(*[y - x for x, y in zip(a[:3], b[:3], strict=True)]))

    both = ends.select("tag", way("").alias("p"), way("ref_").alias("q"))
    d2 = sum((F.col(f"p.{c}") - F.col(f"q.{c}")) ** 2 for c in "xyz")
    return both.groupBy("tag").agg(F.sqrt(F.avg(d2)).alias("rpe"))


def scored(spark: SparkSession, folder: str, truth: DataFrame) -> DataFrame:
    """(tag, sequence, config, error, ate, rpe, and the columns of :func:`metrics` and :func:`logs`): a row for every trajectory file.

    ``truth`` has (sequence, stamp_ns, tx ... qw). ``ate`` is after a rigid fit. A trajectory with broken lines, without
    poses, or that meets no ground truth has an ``error`` and no scores; ``rpe`` is null where the run is shorter than a metre.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.tum").load(folder).select(_tag(".tum"))
    split = lambda df: df.withColumns({"sequence": F.regexp_extract("tag", r"^(.*)\.[^.]*$", 1), "config": F.substring_index("tag", ".", -1)})
    lines = trajectories(spark, folder)
    states = lines.groupBy("tag").agg(F.max("broken").alias("broken"))
    poses = split(lines.join(states.where("not broken").select("tag"), "tag", "left_semi")).drop("broken", "config")
    known = truth.groupBy("sequence", "stamp_ns").agg(F.min(F.struct(*POSE)).alias("ref"))
    near = temporal.nearest_within(poses, known, ["sequence"], "stamp_ns", "stamp_ns", "stamp_ns", GATE_NS).withColumnRenamed("other_seq", "ref_stamp")
    refs = known.select("sequence", F.col("stamp_ns").alias("ref_stamp"), *[F.col(f"ref.{c}").alias(f"ref_{c}") for c in POSE])
    pairs = near.join(refs, ["sequence", "ref_stamp"])
    ate = stats.absolute_error(pairs, ["tag"], POSE[:3], [f"ref_{c}" for c in POSE[:3]], align=True).select("tag", F.col("rmse").alias("ate"))
    out = split(names)
    for part in (states, ate, _relative(pairs), metrics(spark, folder), logs(spark, folder)):
        out = out.join(part, "tag", "left")
    error = F.when(F.col("broken").isNull(), "no poses").when(F.col("broken"), "broken lines").when(F.col("ate").isNull(), "no ground truth within 10 ms")
    return out.select("tag", "sequence", "config", error.alias("error"), *[c for c in out.columns if c not in ("tag", "sequence", "config", "broken")])
