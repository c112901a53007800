import math

import numpy as np
from pyspark.sql import functions as F

from wayfold.operators import folds, registration as reg


def room(pose, beams=540, noise=0.0, rng=None):
    """Ranges to the walls of a 12 x 8 m room with a 1 x 1 m pillar, seen from a pose in it."""
    angle = pose[2] + np.linspace(-2.35, 2.35, beams)
    segments = [((-6, -4), (6, -4)), ((6, -4), (6, 4)), ((6, 4), (-6, 4)), ((-6, 4), (-6, -4)), ((2, 1), (3, 1)), ((3, 1), (3, 2)), ((3, 2), (2, 2)), ((2, 2), (2, 1))]
    out = np.full(beams, np.inf)
    d = np.stack([np.cos(angle), np.sin(angle)], 1)
    for (ax, ay), (bx, by) in segments:
        ex, ey = bx - ax, by - ay
        det = d[:, 0] * -ey + d[:, 1] * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((ax - pose[0]) * -ey + (ay - pose[1]) * ex) / det
            u = (d[:, 0] * (ay - pose[1]) - d[:, 1] * (ax - pose[0])) / det
        hit = (np.abs(det) > 1e-12) & (t > 0) & (u >= 0) & (u <= 1)
        out = np.where(hit & (t < out), t, out)
    return out + (rng.normal(0, noise, beams) if noise else 0)


def row(pose, stamp=0, **more):
    return {"stamp_ns": stamp, "angle_min": -2.35, "angle_increment": 4.7 / 539, "range_min": 0.05, "range_max": 25.0, "ranges": room(pose, **more)}


def test_registration_finds_the_motion():
    a, b = np.array([0.0, 0, 0]), np.array([0.15, -0.1, 0.08])
    found = reg.match(reg.points_of(row(b)), reg.Neighbours(reg.points_of(row(a)), 1.0), np.zeros(3))
    assert np.allclose(found.pose, b, atol=0.01) and found.inliers > 0.7


def test_two_nearest_match_brute_force():
    rng = np.random.default_rng(2)
    refs, queries = rng.uniform(0, 10, (300, 2)), rng.uniform(-1, 11, (80, 2))
    index, dist = reg.Neighbours(refs, 1.0).two(queries)
    for q, i, d in zip(queries, index, dist):
        d2 = ((refs - q) ** 2).sum(1)
        want = [k for k in np.argsort(d2, kind="stable") if d2[k] <= 1][:2]
        assert [k for k in i if k >= 0] == want and np.allclose(d[: len(want)], d2[want])


def test_too_few_points_give_nothing():
    few = np.zeros((5, 2))
    assert reg.match(few, reg.Neighbours(few, 1.0), np.zeros(3)) is None


def test_scan_odometry_follows_a_curve(spark):
    rng = np.random.default_rng(0)
    poses = [np.array([1.5 * math.sin(0.03 * k) - 2, 1.5 * (1 - math.cos(0.03 * k)) - 2, 0.03 * k]) for k in range(60)]
    rows = [("r", 100_000_000 * k, k, -2.35, 4.7 / 539, 0.05, 25.0, [float(x) for x in room(p, noise=0.005, rng=rng)]) for k, p in enumerate(poses)]
    df = spark.createDataFrame(rows, "run string, stamp_ns long, seq long, angle_min double, angle_increment double, range_min double, range_max double, ranges array<double>")
    out = folds.folded(df.repartition(3), reg.ScanOdometry, "run", ["stamp_ns", "seq"]).orderBy("stamp_ns").collect()
    assert sum(r.outcome == "matched" for r in out) >= 55
    last = reg.se2_compose(reg.se2_inverse(poses[0]), poses[-1])
    assert math.hypot(out[-1].x - last[0], out[-1].y - last[1]) < 0.05 and abs(reg.wrap(out[-1].theta - last[2])) < 0.02


def test_a_loop_spreads_the_drift(spark):
    anchors = [("r", k, 10.0 * k, 0.1 * k, 0.0) for k in range(5)]
    edges = [("r", k, k + 1, 10.0, 0.1, 0.0, 0.05, 0.2) for k in range(4)] + [("r", 0, 4, 40.0, 0.0, 0.0, 0.01, 0.05), ("r", 2, 2, 1.0, 1.0, 1.0, 0.1, 0.1), ("r", 0, 9, 1.0, 1.0, 1.0, 0.1, 0.1)]
    a = spark.createDataFrame(anchors, "run string, node int, x double, y double, theta double")
    e = spark.createDataFrame(edges, "run string, `from` int, `to` int, dx double, dy double, dtheta double, sigma_turn double, sigma_move double")
    y = [r.y for r in reg.optimised(a, e, "run").orderBy("node").collect()]
    assert abs(y[4]) < 0.05 and abs(y[0]) < 1e-6 and all(abs(v) < 0.15 for v in y)
    alone = reg.optimised(a, e.where(F.lit(False)), "run").orderBy("node").collect()
    assert [r.y for r in alone] == [0.1 * k for k in range(5)]


def test_points_that_tell_no_direction():
    rng = np.random.default_rng(9)
    wall = np.stack([np.linspace(0, 4, 60), np.where(np.arange(60) < 30, 0.0, np.linspace(-2, 2, 60))], 1) + rng.normal(0, 1e-3, (60, 2))
    alone = np.array([[50.0, 50.0]])
    both = np.concatenate([wall, alone])
    reference = reg.Neighbours(both, 1.0)
    with_alone, without = (reg.match(p, reference, np.zeros(3)) for p in (both, wall))
    assert np.allclose(with_alone.pose, without.pose, atol=1e-12) and np.isfinite(with_alone.residual)
    assert reg.match(wall[:19], reference, np.zeros(3)) is None
    assert reg.match(wall, reg.Neighbours(wall[:19], 1.0), np.zeros(3)) is None
