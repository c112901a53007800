"""Rigs of any depth, colours, picks, late rows of streams, and the aligned error against an explicit fit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import colour
from wayfold.functions import geometry as geo
from wayfold.operators import folds, rig, stats, temporal
from wayfold.plans.registry import QUERIES
from wayfold.streaming.folds import folded_stream


def edges(spark, rows):
    df = spark.createDataFrame(rows, "parent string, child string, x double, yaw double, fixed boolean")
    return df.select("parent", "child", "fixed", geo.pose(geo.vector(F.col("x"), 0.0, 0.0), geo.from_rpy(F.lit(0.0), F.lit(0.0), F.col("yaw"))).alias("pose"))


def test_a_rig_forty_deep(spark):
    e = spark.createDataFrame([(k, k + 1, 0.5) for k in range(40)] + [(40, 0, 9.0)], "parent int, child int, x double")
    found = {r.id: (r.depth, r.x) for r in rig.flattened(e).collect()}
    assert found == {k: (k, 0.5 * k) for k in range(41)}


def test_rig_backwards_and_loose_joints(spark):
    e = edges(spark, [("/base", "arm", 1.0, math.pi / 2, True), ("arm", "hand", 2.0, 0.0, True), ("hand", "wheel", 1.0, 0.0, False), ("base", "hand", 7.0, 0.0, False)])
    found = {r.frame: (r.depth, round(r.pose.tx, 9), round(r.pose.ty, 9)) for r in rig.poses(e, "/hand").collect()}
    assert found == {"hand": (0, 0.0, 0.0), "arm": (1, -2.0, 0.0), "base": (2, -2.0, 1.0)}
    with pytest.raises(ValueError, match="no frame"):
        rig.poses(e, "head")


def test_colours_return(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, c)) for c in rng.uniform(0, 1, (30, 3))] + [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "r double, g double, b double")
    lab = df.withColumns(dict(zip(("l", "a", "bb"), colour.lab(F.col("r"), F.col("g"), F.col("b")), strict=True)))
    back = lab.withColumns(dict(zip(("r2", "g2", "b2"), colour.from_lab(F.col("l"), F.col("a"), F.col("bb")), strict=True)))
    for r in back.collect():
        assert np.allclose([r.r, r.g, r.b], [r.r2, r.g2, r.b2], atol=1e-3)
    white = back.where("r = 1.0 and g = 1.0").first()
    assert white.l == pytest.approx(100, abs=1e-3) and abs(white.a) < 0.02


def test_arc_pairs_begin_where_the_last_one_ended(spark):
    df = spark.createDataFrame([("r", k, 0.4 * k, 0.0) for k in range(11)], "run string, k long, x double, y double")
    found = sorted((r.from_x, r.to_x) for r in stats.arc_pairs(df, "run", ["k"], ["x", "y"], 1.0).collect())
    assert np.allclose(found, [(0.0, 1.2), (1.2, 2.4), (2.4, 3.6)])


def test_info_that_comes_late(spark):
    frames = spark.createDataFrame([("r", k) for k in range(10)], "run string, at long")
    info = spark.createDataFrame([("r", 7, "first"), ("r", 9, "second")], "run string, at long, k string")
    found = {r.at: r.k for r in temporal.with_first_info(frames, info, ["run"], ["at"], ["k"], 3).collect()}
    assert found == {0: "first", 1: "first", 2: "first", 7: "first", 8: "first", 9: "first"}


def test_aligned_error_against_an_explicit_fit(spark):
    found = {r.run_id: r.rmse for r in QUERIES["ate_aligned"](spark, "/root/testdata/sf0.001").collect()}
    from wayfold.plans.queries import _pairs

    runs = {}
    for r in _pairs(spark, "/root/testdata/sf0.001").collect():
        runs.setdefault(r.run_id, []).append((r.ex, r.ey, r.ez, r.x, r.y, r.z))
    assert found.keys() == runs.keys()
    for run, rows in runs.items():
        p, q = np.array(rows)[:, :3], np.array(rows)[:, 3:]
        a, b = p - p.mean(0), q - q.mean(0)
        u, s, vt = np.linalg.svd(b.T @ a / len(p))
        if s[1] <= 1e-12:
            moved = p
        else:
            turn = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
            moved = a @ turn.T + q.mean(0)
        assert found[run] == pytest.approx(float(np.sqrt(((moved - q) ** 2).sum(1).mean())), abs=2e-6)


def test_rows_wait_for_the_watermark(spark, tmp_path):
    rows = [[0, 30, 10], [20, 40, 60], [25, 50, 5, 90]]  # stamps by batch; 5 is too late
    for k, batch in enumerate(rows):
        spark.createDataFrame([("r", t, t) for t in batch], "run string, stamp_ns long, seq long").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema("run string, stamp_ns long, seq long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = folded_stream(stream, lambda: folds.Segments(25), "run", ["stamp_ns", "seq"], delay=20, late=True)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = spark.read.parquet(f"{tmp_path}/out").orderBy("stamp_ns").collect()
    stamps = [r.stamp_ns for r in found]
    assert stamps == sorted(stamps) and set(stamps) >= {0, 10, 20, 30, 40} and 5 not in stamps
    assert [r.segment for r in found] == [t // 25 if t < 50 else r.segment for t, r in zip(stamps, found)]


def test_stationary_and_hand_over(spark):
    df = spark.createDataFrame([("r", k, k, 6.0, True) for k in range(12)], "run string, stamp_ns long, seq long, moved double, fused boolean")
    still = folds.folded(df, folds.Stationary, "run", ["stamp_ns"]).select("tx", "qw").distinct().collect()
    assert [tuple(r) for r in still] == [(0.0, 1.0)]
    found = folds.folded(df, lambda: folds.HandOver(20.0, 2), "run", ["stamp_ns", "seq"]).orderBy("stamp_ns").collect()
    assert [(r.submap, r.also) for r in found] == [(0, None)] * 4 + [(1, 0)] * 2 + [(1, None)] * 2 + [(2, 1)] * 2 + [(2, None)] * 2


def test_suppression_of_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(8)
    boxes = []
    for i in range(300):
        w, h = (float(x) for x in np.exp(rng.uniform(-3, 4, 2)))
        x, y = (float(v) for v in rng.uniform(0, 20, 2))
        boxes.append((i, round(float(rng.uniform(0, 1)), 2), x, y, x + w, y + h))
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[1], b[0])):
        if all(folds.overlap(b[2:], k[2:]) <= 0.3 for k in kept):
            kept.append(b)
    from wayfold.operators import spatial

    df = spark.createDataFrame([(0, *b) for b in boxes], "f int, id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.id for r in spatial.suppressed(df, ["f"], ["score"], 0.3).collect()) == sorted(b[0] for b in kept)
