"""Fields, carving, batch registration and loop closures against maps kept ray by ray and poses known beforehand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import fields, spatial, voxel


def by_hand(rays, f):
    """A map kept ray by ray, in plain Python."""
    cells = {}
    seen = {tuple(math.floor((o + s * (p - o) / dist) / f.voxel) for o, p in zip(a, b)) for a, b, _ in rays for dist in [math.dist(a, b)] if dist >= 1e-9 for s in band(dist, f)}
    for a, b, red in rays:
        dist = math.dist(a, b)
        if dist < 1e-9:
            continue
        at = lambda s: tuple(math.floor((o + s * (p - o) / dist) / f.voxel) for o, p in zip(a, b))  # noqa: B023,E731
        free, last = max(dist - f.truncation, 0.0) - f.voxel, None
        if f.carve < 1 and free >= f.voxel:
            for k in range(math.floor(free / f.voxel) + 2):
                s = min(k * f.voxel, free)
                if f.margin and not dist - s > max(f.margin * s, 2 * f.truncation):
                    continue
                if at(s) != last:
                    last = at(s)
                    c = cells.get(last)
                    if c and c["w"] > 0 and last in seen:
                        c["w"] *= f.carve
                        if c["w"] < 1:
                            c.update(t=0.0, w=0.0, red=0.0, n=0)
        last, coloured = None, False
        for s in band(dist, f):
            if at(s) == last:
                continue
            last = at(s)
            c = cells.setdefault(last, {"t": 0.0, "w": 0.0, "red": 0.0, "n": 0})
            c["t"] = (c["t"] * c["w"] + max(-f.truncation, min(f.truncation, dist - s))) / (c["w"] + 1)
            c["w"] = min(c["w"] + 1, f.most)
            if last == tuple(math.floor(p / f.voxel) for p in b) and not coloured:
                coloured = True
                c["red"] += (red - c["red"]) / (c["n"] + 1)
                c["n"] = min(c["n"] + 1, 32)
    return cells


def band(dist, f):
    start, end = max(dist - f.truncation, 0.0), dist + f.truncation
    return [min(start + k * f.voxel / 2, end) for k in range(math.floor((end - start) / (f.voxel / 2)) + 2)]


@pytest.mark.parametrize("f", [fields.Field(0.2, 0.5, 64, 0.5, 0.1), fields.Field(0.2, 0.5, 4, 0.7, 0.0), fields.Field(0.2, 0.5, 4, 1.0, 0.0)])
def test_carving_ray_by_ray(spark, f):
    rng = np.random.default_rng(4)
    rays = [((0.03, 0.04, 0.05), tuple(float(x) for x in (rng.uniform(1, 4) if k % 3 else rng.uniform(5, 6), rng.normal(0, 0.2), rng.normal(0, 0.1))), float(k)) for k in range(120)]
    df = spark.createDataFrame([(k, *a, *b, c) for k, (a, b, c) in enumerate(rays)], "k long, ox double, oy double, oz double, px double, py double, pz double, red double").withColumn("map", F.lit("m"))
    found = {(r.ix, r.iy, r.iz): r for r in fields.fused(df, ["map"], ["k"], f, "red").collect()}
    want = by_hand(rays, f)
    assert found.keys() == want.keys()
    for cell, c in want.items():
        r = found[cell]
        assert math.isclose(r.tsdf, c["t"], abs_tol=1e-9) and math.isclose(r.weight, c["w"], abs_tol=1e-9) and (r.red or 0.0) == pytest.approx(c["red"]) and r.n_red == c["n"]
    assert f.carve == 1 or any(c["w"] == 0 for c in want.values())


def test_carving_leaves_few_ghosts(spark):
    """Someone stood in the way for a while; rays that fly on to the wall remove what was seen of them."""
    f = fields.Field(0.1, 0.3, 64, 0.5, 0.1)
    person = [((0.0, 0.0, 0.05), (2.0, y, 0.05)) for y in np.linspace(-0.3, 0.3, 31)]
    wall = [((0.0, 0.0, 0.05), (6.0, y * 3, 0.05)) for y in np.linspace(-0.6, 0.6, 121)]
    rays = person * 3 + wall * 8
    df = spark.createDataFrame([(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(rays)], "k long, ox double, oy double, oz double, px double, py double, pz double")
    ghosts = lambda g: fields.fused(df, [], ["k"], g).where("weight > 0 and ix < 30").count()
    before, after = ghosts(fields.Field(0.1, 0.3, 64, 1.0, 0.1)), ghosts(f)
    assert before > 30 and after < before / 5


def test_gradients_of_a_plane(spark):
    cells = [(ix, iy, iz, 0.1 * ix + 0.2 * iy - 0.3 * iz, 1) for ix in range(4) for iy in range(4) for iz in range(2)]
    voxels = spark.createDataFrame(cells, "ix long, iy long, iz long, tsdf double, weight long")
    points = spark.createDataFrame([(1, 1.7, 2.2, 0.9), (2, 1.5, 1.5, 1.9), (3, 9.0, 9.0, 9.0)], "id long, x double, y double, z double")
    found = {r.id: r for r in voxel.gradients(points, voxels, "id", 1.0).collect()}
    assert np.allclose([found[1].gx, found[1].gy, found[1].gz], [0.1, 0.2, -0.3])
    assert np.allclose([found[2].gx, found[2].gy, found[2].gz], [0.1, 0.2, 0.0]) and found[2].sdf == pytest.approx(0.0)
    assert found[3].sdf is None and found[3].gx is None


def corner_field(spark, f, at=(0.0, 0.0)):
    """Distance to the two walls x = 3 and y = 2 around their corner, seen from the origin, in one layer."""
    n = int(4 / f.voxel)
    cells = []
    for ix in range(-n, n):
        for iy in range(-n, n):
            x, y = (ix + 0.5) * f.voxel, (iy + 0.5) * f.voxel
            d = min(3 - x, 2 - y)
            if abs(d) <= f.truncation and x < 3.4 and y < 2.4:
                cells.append((ix, iy, 0, d, 1.0))
    return spark.createDataFrame(cells, "ix long, iy long, iz long, tsdf double, weight double")


def corner_scan(pose):
    world = [(3.0, y) for y in np.linspace(-2, 1.7, 120)] + [(x, 2.0) for x in np.linspace(-2, 2.7, 120)]
    c, s = math.cos(pose[2]), math.sin(pose[2])
    return [(c * (x - pose[0]) + s * (y - pose[1]), c * (y - pose[1]) - s * (x - pose[0]), 0.0) for x, y in world]


def test_registration_of_many_scans_at_once(spark):
    f = fields.Field(0.1, 0.3)
    voxels = corner_field(spark, f).withColumn("map", F.lit("m"))
    poses = {1: (0.1, -0.05, 0.03), 2: (-0.08, 0.1, -0.04), 3: (0.0, 0.0, 0.0)}
    points = spark.createDataFrame([("m", k, i, *map(float, p)) for k, pose in poses.items() for i, p in enumerate(corner_scan(pose))], "map string, scan long, pid int, x double, y double, z double")
    starts = spark.createDataFrame([("m", k, 0.0, 0.0, 0.0) for k in (1, 2, 3, 4)], "map string, scan long, x double, y double, theta double")
    found = {r.scan: r for r in fields.register(points, voxels, starts, ["map"], "scan", f, rounds=6).collect()}
    for k, pose in poses.items():
        assert np.allclose([found[k].x, found[k].y, found[k].theta], pose, atol=5e-3) and found[k].inliers > 0.8
    assert (found[4].x, found[4].inliers) == (0.0, 0.0)  # no points: the pose stays


def test_loops_close_where_they_verify(spark):
    f = fields.Field(0.1, 0.3)
    voxels = corner_field(spark, f).withColumn("submap", F.lit(7)).select("submap", "ix", "iy", "iz", "tsdf", "weight")
    anchors = spark.createDataFrame([(7, 1.0, 2.0, math.pi / 2), (8, 50.0, 0.0, 0.0)], "submap int, x double, y double, theta double")
    true = (0.05, -0.1, 0.02)  # in the anchor's frame
    points = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(corner_scan(true))], "scan int, pid int, x double, y double, z double")
    world = (1.0 - true[1] + 0.35, 2.0 + true[0] - 0.3, math.pi / 2 + true[2] + 0.06)  # drifted
    scans = spark.createDataFrame([(1, *world), (2, 90.0, 0.0, 0.0)], "scan int, x double, y double, theta double")
    (r,) = fields.loop_closures(scans, points, anchors, voxels, f, rounds=5).collect()
    assert (r.scan, r.submap) == (1, 7) and np.allclose([r.x, r.y, r.theta], true, atol=0.01) and r.inliers > 0.8


def test_strides_have_no_end(spark):
    df = spark.createDataFrame([(0.0001,), (1.0,), (0.05 * 380 / 2048,), (19.0,), (0.05 * 380 / 8,)], "z double")
    found = [r.s for r in df.select(spatial.stride_for(F.col("z"), F.lit(380.0), 0.05, 2).alias("s")).collect()]
    assert found == [131072, 16, 2048, 2, 8]
