"""Submaps kept pose by pose in plain Python, and factor graphs against a dense solver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import fields, graphs, registration, submaps


def walked(cfg, poses):
    """(fused, submap, also, spawned) of (kind, x, y, theta), and the anchors."""
    last, before, out, anchors = {}, None, [], [poses[0][1:]]
    submap, way, left = 0, 0.0, 0
    for kind, x, y, t in poses:
        way += math.dist((x, y), before) if before else 0.0
        before = (x, y)
        p = last.get(kind)
        due = p is None or math.dist((x, y), p[:2]) > cfg.move or abs(math.remainder(t - p[2], 2 * math.pi)) > cfg.turn
        row = [due, submap, submap - 1 if left else None, None]
        if due:
            last[kind] = (x, y, t)
            left = max(0, left - 1)
            if way > cfg.extent and left == 0:
                submap, way, left = submap + 1, 0.0, cfg.overlap
                row[3] = submap
                anchors.append((x, y, t))
        out.append(tuple(row))
    return out, anchors


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(2)
    n = 120
    xy = np.cumsum(rng.uniform(0, 0.15, (n, 2)), 0)
    return [(["scan", "cloud"][int(rng.random() < 0.3)], float(x), float(y), float(t)) for (x, y), t in zip(xy, rng.uniform(-3, 3, n) * 0.02)]


def test_gates_hand_over_and_dual_integration(spark, walk):
    cfg = submaps.Mapping(0.1, 0.1, 2.0, 6)
    rows = [("r", k * 10, k, *p) for k, p in enumerate(walk)]
    df = spark.createDataFrame(rows, "run string, stamp_ns long, seq long, kind string, x double, y double, theta double")
    events = submaps.fusions(df, "run", cfg).cache()
    want, anchors = walked(cfg, walk)
    found = events.orderBy("seq").collect()
    assert [(r.fused, r.submap, r.also, r.spawned) for r in found] == want and len(anchors) > 3
    at = submaps.anchors(events, "run")
    assert np.allclose([(r.x, r.y, r.theta) for r in at.orderBy("submap").collect()], anchors)
    hops = submaps.hand_over_edges(at, "run").orderBy("to").collect()
    assert [(h["from"], h.to) for h in hops] == [(k, k + 1) for k in range(len(anchors) - 1)]
    for h, a, b in zip(hops, anchors, anchors[1:]):
        assert np.allclose((h.dx, h.dy, h.dtheta), registration.se2_compose(registration.se2_inverse(np.array(a)), np.array(b)))
    # one point each, the colours of which are three channels
    points = df.select("run", "seq", F.lit(0).alias("pid"), *[F.lit(0.0).alias(f"o{a}") for a in "xyz"], F.lit(1.0).alias("px"), F.lit(0.25).alias("py"), (F.col("seq") % 3 * 0.2).alias("pz"), F.lit(10.0).alias("red"), F.col("seq").cast("double").alias("green"), F.lit(30.0).alias("blue"))
    field = fields.Field(0.25, 0.5, 1e5, 1.0, 0.0)
    rays = submaps.local_rays(points, events, at, "run").collect()
    wanted = []
    for k, ((kind, x, y, t), (due, submap, also, _)) in enumerate(zip(walk, want)):
        for target in [submap, also] if due else []:
            if target is not None:
                local = registration.se2_compose(registration.se2_inverse(np.array(anchors[target])), np.array([x, y, t]))
                p = registration.se2_apply(local, np.array([[1.0, 0.25]]))[0]
                wanted.append((k, target, *p))
    assert np.allclose(sorted((r.seq, r.submap, r.px, r.py) for r in rays), sorted(wanted))
    _, space, plane = submaps.dual(points, events, "run", field, field, 0.1, F.lit(True), [0.4], ("red", "green", "blue"))
    total = space.groupBy("submap").agg(F.sum("observed").alias("n"), F.max("red").alias("red"), F.max("blue").alias("blue")).orderBy("submap").collect()
    assert [r.submap for r in total] == list(range(len(anchors))) and all(r.red == 10.0 and r.blue == 30.0 for r in total)
    flat = {(r.submap, r.iz) for r in plane.select("submap", "iz").distinct().collect()}
    assert {z for _, z in flat} == {0}
    states = {r.submap: r.state for r in submaps.states(events, "run").collect()}
    last = found[-1].left
    assert states[len(anchors) - 1] == "active" and states[len(anchors) - 2] == ("overlap" if last else "frozen") and states[0] == "frozen"


def test_submaps_move_with_their_anchors(spark):
    at = spark.createDataFrame([("r", 0, 0.0, 0.0, 0.0), ("r", 1, 4.0, 1.0, 0.5)], "run string, submap int, x double, y double, theta double")
    moved = spark.createDataFrame([("r", 1, 5.0, 2.0, math.pi / 2)], "run string, node int, x double, y double, theta double")
    new = submaps.reposed(at, moved, "run")
    voxels = spark.createDataFrame([("r", 0, 1, 0, 0, 0.1), ("r", 1, 1, 0, 0, 0.1)], "run string, submap int, ix long, iy long, iz long, tsdf double")
    found = {r.submap: (r.wx, r.wy, r.wz) for r in submaps.placed(voxels, new, "run", 0.5, (1.0, 0.0, 0.0)).collect()}
    assert found[0] == pytest.approx((1.75, 0.25, 0.25)) and found[1] == pytest.approx((6.0 - 0.25, 2.0 + 0.75, 0.25))
    poses = spark.createDataFrame([("r", 1, 4.0 + math.cos(0.5), 1.0 + math.sin(0.5), 0.7, "kept")], "run string, submap int, x double, y double, theta double, note string")
    p = submaps.carried(poses, at, new, "run").first()
    assert (p.x, p.y, p.theta, p.note) == (pytest.approx(5.0), pytest.approx(3.0), pytest.approx(math.pi / 2 + 0.2), "kept")


@pytest.mark.parametrize("solve", [submaps.solved, registration.optimised, None])
def test_closures_move_anchors_or_snap(spark, solve):
    """A square of four submaps told with drift, whose last pose sees the first submap; a run without closure stays."""
    truth = np.array([[0, 0, 0], [5, 0, math.pi / 2], [5, 5, math.pi], [0, 5, -math.pi / 2]], float)
    told = truth + np.arange(4)[:, None] * [0.1, 0.05, 0.02]
    rows = [(r, k, k, *map(float, p)) for r in ("a", "b") for k, p in enumerate(told)]
    at = spark.createDataFrame(rows, "run string, submap int, seq long, x double, y double, theta double")
    ahead = np.array([0.5, 0.1, 0.2])
    events = spark.createDataFrame([(r, k, k, None, *map(float, registration.se2_compose(p, ahead))) for r in ("a", "b") for k, p in enumerate(told)], "run string, seq long, submap int, also int, x double, y double, theta double")
    seen = registration.se2_compose(registration.se2_inverse(truth[0]), registration.se2_compose(truth[3], ahead))
    closures = spark.createDataFrame([("a", 3, 0, *map(float, seen))], "run string, seq long, target int, cx double, cy double, ctheta double")
    new, poses = submaps.closed(closures, events, at, "run", solve)
    hops = [(k, k + 1, registration.se2_compose(registration.se2_inverse(told[k]), told[k + 1]), *submaps.ODOMETRY) for k in range(3)]
    loop = (0, 3, registration.se2_compose(seen, registration.se2_inverse(ahead)), *submaps.LOOP)
    want = told if solve is None else registration.optimise(told, [*hops, loop])
    got = {(r.run, r.submap): (r.x, r.y, r.theta) for r in new.collect()}
    p = {(r.run, r.seq): np.array([r.x, r.y, r.theta]) for r in poses.collect()}
    for k in range(4):
        assert got["b", k] == pytest.approx(tuple(told[k])) and got["a", k] == pytest.approx(tuple(want[k]), abs=1e-5)
        of = registration.se2_compose(want[0], seen) if k == 3 else registration.se2_compose(want[k], ahead)
        assert np.allclose(p["a", k], of, atol=1e-5) and np.allclose(p["b", k], registration.se2_compose(told[k], ahead))


def ring(n, loops, noise, seed=1):
    rng = np.random.default_rng(seed)
    a = np.arange(n) * 2 * math.pi / 40
    truth = np.stack([10 * np.cos(a) + a, 10 * np.sin(a), (a + math.pi / 2 + math.pi) % (2 * math.pi) - math.pi], 1)
    pairs = [(k, k + 1, 0.05, 0.2) for k in range(n - 1)] + [(k, k + 39, 0.01, 0.05) for k in range(0, n - 40, loops)]
    measured = [(i, j, registration.se2_compose(registration.se2_inverse(truth[i]), truth[j]) + rng.normal(0, noise, 3) * [sm, sm, st], st, sm) for i, j, st, sm in pairs]
    start = truth + np.cumsum(rng.normal(0, 0.003, (n, 3)), 0)
    start[0] = truth[0]
    return truth, start, measured


def frames(spark, name, start, edges):
    a = spark.createDataFrame([(name, k, *map(float, r)) for k, r in enumerate(start)], "run string, node long, x double, y double, theta double")
    e = spark.createDataFrame([(name, i, j, *map(float, z), st, sm) for i, j, z, st, sm in edges], "run string, `from` long, `to` long, dx double, dy double, dtheta double, sigma_turn double, sigma_move double")
    return a, e


def test_planar_graphs_against_dense_equations(spark):
    _, start, edges = ring(75, 9, 0.05)
    a, e = frames(spark, "one", start, [*edges, (3, 3, np.zeros(3), 0.1, 0.1), (5, 999, np.zeros(3), 0.1, 0.1)])
    alone, none = frames(spark, "alone", start[:2], [])
    report = graphs.planar(a.unionByName(alone), e.unionByName(none), "run", block=24, most=4)
    found = {g: np.array([r.value for r in sorted(rows, key=lambda r: r.v)]) for g, rows in _by_graph(report.variables).items()}
    assert np.abs(found["one"] - registration.optimise(start, edges)).max() < 1e-5
    assert np.allclose(found["alone"], start[:2])
    g = report.graphs.collect()
    assert [r.graph for r in g] == ["one"] and g[0].final_error < 0.1 * g[0].initial_error


def test_what_blocks_leave_goes_to_conjugate_gradients(spark):
    """Two graphs whose equations don't fit a task of two variables, against dense equations."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for graph, n in (("a", 4), ("b", 3)):
        h, g = np.zeros((n, n)), np.zeros(n)
        for i, j in [(k, k + 1) for k in range(n - 1)] + [(0, n - 1)]:
            jac, r = rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 3)
            e = jac.T @ jac
            h[np.ix_([i, j], [i, j])] += e
            g[[i, j]] += jac.T @ r
            rows.append((graph, [i, j], [1, 1], e.tobytes(), (jac.T @ r).tobytes(), np.diag(e).tobytes(), 1e-3))
        want[graph] = np.linalg.solve(h + 1e-3 * np.diag(np.diag(h)), -g)
    elements = spark.createDataFrame([(g, v, d, bytearray(h), bytearray(x), bytearray(y), lam) for g, v, d, h, x, y, lam in rows], graphs.ELEMENT)
    for found in (graphs.steps(elements, block=2, limit=1), graphs.steps(elements, block=2)):
        got = {(r.graph, r.v): r.step[0] for r in found.collect()}
        assert len(got) == 7 and all(got[g, k] == pytest.approx(x, abs=1e-5) for g, v in want.items() for k, x in enumerate(v))


def _by_graph(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.graph, []).append(r)
    return out


def test_graph_in_space_with_velocities_and_inertial_factors(spark):
    """A body under constant acceleration and turn rate, seen through preintegrated motion: states and bias come back."""
    dt, n = 0.5, 6
    acc, rate = np.array([0.4, 0.1, 9.80665]), np.array([0.0, 0.0, 0.3])
    poses, speeds, motions = [(np.zeros(3), np.zeros(3))], [np.array([1.0, 0.0, 0.0])], []
    for _ in range(n - 1):
        q, p = poses[-1]
        v, steps = speeds[-1], 500
        dr, dv, dp, h = np.eye(3), np.zeros(3), np.zeros(3), dt / 500
        for _ in range(steps):
            dp, dv = dp + dv * h + dr @ acc * h * h / 2, dv + dr @ acc * h
            dr = dr @ graphs.turn((rate * h)[None])[0]
        r = graphs.turn(q[None])[0]
        motions.append(np.concatenate([[dt], graphs.turned_by(dr[None])[0], dv, dp]))
        poses.append((graphs.turned_by((r @ dr)[None])[0], p + v * dt + graphs.GRAVITY * dt * dt / 2 + r @ dp))
        speeds.append(v + graphs.GRAVITY * dt + r @ dv)
    rng = np.random.default_rng(0)
    rows, factors = [], []
    for k in range(n):
        off = 0.0 if k == 0 else 0.02
        rows.append(("g", 4 * k, "pose", [float(x) for x in np.concatenate(poses[k]) + rng.normal(0, 1, 6) * off]))
        rows.append(("g", 4 * k + 1, "velocity", [float(x) for x in speeds[k] + rng.normal(0, 1, 3) * off]))
    rows.append(("g", 2, "bias", [0.01] * 6))
    factors.append(("g", "prior", [0], [float(x) for x in np.concatenate(poses[0])] + [1e-4] * 6))
    factors.append(("g", "velocity prior", [1], [float(x) for x in speeds[0]] + [1e-4] * 3))
    factors.append(("g", "bias prior", [2], [0.0] * 6 + [1e-3] * 6))
    for k, m in enumerate(motions):
        factors.append(("g", "inertial", [4 * k, 4 * k + 1, 4 * k + 4, 4 * k + 5, 2], [float(x) for x in m] + [1e-3] * 3))
    (q0, p0), (q5, p5) = poses[0], poses[5]
    r0 = graphs.turn(q0[None])[0].T
    between = np.concatenate([graphs.turned_by((r0 @ graphs.turn(q5[None])[0])[None])[0], r0 @ (p5 - p0)])
    factors.append(("g", "between", [0, 20], [float(x) for x in between] + [0.01] * 3 + [0.05] * 3))
    report = graphs.optimised(spark.createDataFrame(rows, "graph string, v long, kind string, value array<double>"), spark.createDataFrame(factors, "graph string, kind string, vars array<long>, data array<double>"), most=5)
    got = {r.v: np.array(r.value) for r in report.variables.collect()}
    assert np.abs(got[2]).max() < 1e-5
    for k in range(n):
        assert np.allclose(got[4 * k], np.concatenate(poses[k]), atol=1e-5) and np.allclose(got[4 * k + 1], speeds[k], atol=1e-5)


def test_rotation_vectors_and_matrices():
    rng = np.random.default_rng(3)
    w = rng.normal(0, 1, (200, 3))
    w *= (rng.uniform(0, math.pi, 200) / np.linalg.norm(w, axis=1))[:, None]
    w = np.concatenate([w, [[0, 0, 0], [1e-9, 0, 0], [math.pi, 0, 0], [0, 0, 3.1415]]])
    r = graphs.turn(w)
    assert np.allclose(r @ r.transpose(0, 2, 1), np.eye(3)) and np.allclose(graphs.turn(graphs.turned_by(r)), r, atol=1e-9)
    assert np.allclose(graphs.turned_by(r)[:200], w[:200], atol=1e-7)
