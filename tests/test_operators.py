import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry as geo
from wayfold.functions.time import format_stamp, parse_stamp
from wayfold.operators import folds, spatial, stats, temporal, voxel
from wayfold.streaming.folds import folded_stream


def test_stamps_are_exact(spark):
    cases = {"1305031910.765238": 1305031910765238000, "-0.5": -500000000, ".5": 500000000, "7": 7 * 10**9, "1.": 10**9, "0.1234567899": 123456789, "+2.5": 2500000000, " 3 ": 3 * 10**9}
    bad = ["", ".", "1e9", "1_000", "a", "--1", "1.2.3", "9" * 25, "9999999999.0"]
    df = spark.createDataFrame([(t,) for t in [*cases, *bad]], "t string").select("t", parse_stamp(F.col("t")).alias("ns")).collect()
    assert {r.t: r.ns for r in df} == cases | dict.fromkeys(bad)
    shown = spark.createDataFrame([(-1,), (1500000000,), (0,)], "n long").select(format_stamp(F.col("n")).alias("s")).collect()
    assert [r.s for r in shown] == ["-1.999999999", "1.500000000", "0.000000000"]


def test_poses_undo_themselves(spark):
    p = geo.literal_pose(1.0, 2.0, -3.0, 0.1, -0.4, 2.0)
    df = spark.range(1).select(p.alias("p")).withColumn("i", geo.inverse(F.col("p"))).withColumn("c", geo.compose(F.col("p"), F.col("i"))).withColumn("r", geo.to_rpy(F.col("p")))
    row = df.first()
    assert np.allclose(list(row.c), [0, 0, 0, 0, 0, 0, 1], atol=1e-12) and np.allclose(list(row.r), [0.1, -0.4, 2.0])
    turned = spark.range(1).select(geo.wrap_angle(F.lit(3 * math.pi)).alias("a"), geo.wrap_angle(F.lit(-math.pi)).alias("b")).first()
    assert math.isclose(turned.a, math.pi) and math.isclose(turned.b, math.pi)


def test_interpolation_keeps_the_ends(spark):
    base = spark.createDataFrame([("r", t, i) for i, t in enumerate([0, 10, 15, 30, 31])], "run string, t long, seq long")
    other = spark.createDataFrame([("r", 10, 0, 1.0), ("r", 20, 1, 3.0), ("r", 30, 2, 3.0)], "run string, t long, oseq long, v double")
    found = temporal.interpolate_at(base, other, ["run"], "t", "seq", "oseq", "v", "out").collect()
    assert sorted((r.t, r.out) for r in found) == [(10, 1.0), (15, 2.0), (30, 3.0)]


def test_latest_is_gated_strictly(spark):
    base = spark.createDataFrame([("r", 100, 1), ("r", 149, 2), ("r", 150, 3), ("r", 5, 4)], "run string, t long, seq long")
    other = spark.createDataFrame([("r", 100, 7)], "run string, t long, o long")
    found = temporal.latest_before(base, other, ["run"], "t", "seq", "o", ["o"], 50).collect()
    assert {r.seq: r.o for r in found} == {1: 7, 2: 7, 3: None, 4: None}


def test_aligned_error_of_a_rigid_motion_is_zero(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(50, 3))
    c, s = math.cos(0.7), math.sin(0.7)
    q = p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [1, 2, 3]
    df = spark.createDataFrame([("r", *map(float, a), *map(float, b)) for a, b in zip(p, q)], "run string, a double, b double, c double, x double, y double, z double")
    row = stats.absolute_error(df, ["run"], ["a", "b", "c"], ["x", "y", "z"], align=True).first()
    assert row.rmse < 1e-9


def test_nearest_ranks_and_empty_figures(spark):
    df = spark.createDataFrame([("a", float(k * 1000)) for k in range(1, 11)], "k string, ns double")
    r = stats.latency_stats(df, ["k"], "ns").first()
    assert (r.p50, r.p95, r.p99, r.max) == (5.0, 10.0, 10.0, 10.0)
    none = stats.mean_std(spark.createDataFrame([("a", float("nan")), ("a", None)], "k string, v double"), ["k"], "v").first()
    assert math.isnan(none.mean) and math.isnan(none.std)


def test_suppression_is_greedy(spark):
    df = spark.createDataFrame([(0, 1, 0.9, 0.0, 0.0, 2.0, 2.0), (0, 2, 0.8, 0.1, 0.1, 2.1, 2.1), (0, 3, 0.7, 5.0, 5.0, 6.0, 6.0), (0, 4, 0.9, 0.0, 0.0, 2.0, 2.0)], "f int, id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.id for r in spatial.suppressed(df, ["f"], ["score"], 0.45).collect()) == [1, 3]


def test_sampling_a_plane_is_exact(spark):
    cells = [(ix, iy, iz, 0.1 * ix + 0.2 * iy - 0.3 * iz, 1) for ix in range(4) for iy in range(4) for iz in range(2)]
    voxels = spark.createDataFrame(cells, "ix long, iy long, iz long, tsdf double, weight long")
    points = spark.createDataFrame([(1, 1.7, 2.2, 0.9), (2, 1.5, 1.5, 1.9), (3, 9.0, 9.0, 9.0)], "id long, x double, y double, z double")
    found = {r.id: r.sdf for r in voxel.sampled(points, voxels, "id", 1.0).collect()}
    assert math.isclose(found[1], 0.1 * 1.2 + 0.2 * 1.7 - 0.3 * 0.4, abs_tol=1e-12)
    assert math.isclose(found[2], 0.1 + 0.2 - 0.3) and 3 not in found


def samples(spark, n=400):
    t = F.col("id") / 200.0
    w = 2 * math.pi / 10
    return spark.range(n).select(
        F.lit("r").alias("run"), (F.col("id") * 5_000_000).alias("stamp_ns"), F.col("id").alias("seq"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), F.lit(0.0).alias("gz"),
        (1.5 * w * w * F.cos(w * t)).alias("ax"), F.lit(0.0).alias("ay"), F.lit(folds.GRAVITY).alias("az"),
    )


def test_dead_reckoning_follows_the_analytic_path(spark):
    last = folds.folded(samples(spark), folds.DeadReckoning, "run", ["stamp_ns", "seq"]).orderBy(F.desc("stamp_ns")).first()
    t = last.stamp_ns * 1e-9
    assert abs(last.tx - 1.5 * (1 - math.cos(2 * math.pi / 10 * t))) < 0.02 and abs(last.tz) < 1e-9


def test_tilt_finds_gravity(spark):
    lean = samples(spark, 50).withColumns({"ax": F.lit(0.0), "ay": F.lit(folds.GRAVITY * math.sin(0.2)), "az": F.lit(folds.GRAVITY * math.cos(0.2))})
    rows = folds.folded(lean, folds.Tilt, "run", ["stamp_ns", "seq"]).collect()
    assert all(abs(r.roll - 0.2) < 1e-6 and abs(r.pitch) < 1e-9 and r.initialised for r in rows)


def test_stream_and_batch_agree(spark, tmp_path):
    rows = samples(spark, 200)
    want = sorted(map(tuple, folds.folded(rows, folds.DeadReckoning, "run", ["stamp_ns", "seq"]).collect()))
    for k in range(4):
        rows.where((F.col("seq") >= 50 * k) & (F.col("seq") < 50 * k + 50)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = folded_stream(stream, folds.DeadReckoning, "run", ["stamp_ns", "seq"])
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert len(got) == len(want) and np.allclose([g[1:] for g in got], [w[1:] for w in want])


@pytest.mark.parametrize("name", ["DeadReckoning", "Tilt", "Keyframes", "Segments"])
def test_folds_of_nothing(spark, name):
    fold = getattr(folds, name)
    empty = samples(spark, 1).where("seq < 0").withColumns({"x": F.lit(0.0), "y": F.lit(0.0), "theta": F.lit(0.0)})
    assert folds.folded(empty, fold, "run", ["stamp_ns", "seq"]).count() == 0
