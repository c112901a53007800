"""Rays are walked, lifted and carved without sorting them or repeating work for each use."""

from pyspark.sql import functions as F

from wayfold.operators import fields, voxel
from wayfold.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_rays(spark, n=200):
    df = spark.range(n).withColumnRenamed("id", "k").withColumns({f"o{a}": F.lit(0.03) for a in "xyz"})
    return df.withColumns({"px": 1.0 + F.col("k") % 7 * 0.4, "py": F.col("k") % 5 * 0.1, "pz": F.lit(0.2), "red": F.col("k").cast("double"), "map": F.col("k") % 2})


def test_points_are_lifted_without_repeating_what_they_are_made_of(spark):
    assert planned(QUERIES["lifted_points"](spark, SF)).count("get_json_object") <= 2


def test_rays_are_walked_without_a_window(spark):
    rays = some_rays(spark)
    assert "Window" not in planned(voxel.ray_observations(rays, ["k"], 0.25, 0.5))
    assert "Window" not in planned(fields.fused(rays, ["map"], ["k"], fields.Field(0.25, 0.5, 1e5, 0.5, 0.1), "red"))


def test_means_within_a_high_cap_are_shuffled_once(spark):
    seen = voxel.ray_observations(some_rays(spark), ["k"], 0.25, 0.5)
    plan = voxel.capped_mean(seen, ["ix", "iy", "iz"], "obs", 100_000, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_voxels_that_batches_cut(spark):
    rays, field = some_rays(spark), fields.Field(0.2, 0.5, 4, 0.7, 0.0)
    found = lambda: {r[:4]: r[4:] for r in fields.fused(rays, ["map"], ["k"], field, "red").collect()}
    want = found()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)
    try:
        assert found() == want and any(r.carved for r in fields.fused(rays, ["map"], ["k"], field).collect())
    finally:
        spark.conf.set(name, before)


def test_passes_that_follow_each_other_count_each():
    one, many = fields.Voxel(64, 0.5), fields.Voxel(64, 0.5)
    for v in (one, many):
        for k in range(5):
            v.seen(0.1 * k, (float(k),))
    for _ in range(9):
        one.passed(1)
    many.passed(9)
    assert one.finish() == many.finish() and many.carved == 3
