"""Only small graphs are solved in one task; per-variable tables of large ones are not broadcast."""

import math

import numpy as np

from wayfold.operators import graphs, registration, submaps


def test_large_graphs_are_not_solved_densely(spark, monkeypatch):
    sizes, hop = {1: 3, 2: 8}, (1.0, 0.1, 0.2)
    told, edges = [], []
    for run, n in sizes.items():
        told += [(run, k, k * 1.05, k * 0.02, k * 0.19) for k in range(n)]
        edges += [(run, k, k + 1, *hop, 0.05, 0.2) for k in range(n - 1)] + [(run, 0, n - 1, n * 0.9, 0.3, 0.15 * n, 0.01, 0.05)]
    a = spark.createDataFrame(told, "run_id long, node int, x double, y double, theta double")
    e = spark.createDataFrame(edges, "run_id long, `from` int, `to` int, dx double, dy double, dtheta double, sigma_turn double, sigma_move double")
    sparse, plain = [], submaps.solved
    monkeypatch.setattr(submaps, "solved", lambda anchors, *rest: sparse.append({r.run_id for r in anchors.collect()}) or plain(anchors, *rest))
    found = {(r.run_id, r.node): (r.x, r.y, r.theta) for r in submaps.solved_by_size(a, e, "run_id", 5).collect()}
    assert sparse == [{2}] and len(found) == len(told)
    for run in sizes:
        want = registration.optimise(np.array([t[2:] for t in told if t[0] == run]), [(i, j, np.array([x, y, t]), st, sm) for r, i, j, x, y, t, st, sm in edges if r == run])
        assert all(math.dist(found[run, k], w) < 1e-5 for k, w in enumerate(want))


def test_values_and_steps_are_not_broadcast(spark):
    variables = spark.createDataFrame([("a", k, "planar", [float(k), 0.0, 0.0]) for k in range(4)], "graph string, v long, kind string, value array<double>")
    factors = spark.createDataFrame([("a", "planar between", [k, k + 1], [1.0, 0.0, 0.0, 0.1, 0.1]) for k in range(3)], "graph string, kind string, vars array<long>, data array<double>")
    state = spark.createDataFrame([("a", 1e-5)], "graph string, lam double")
    step = spark.createDataFrame([("a", 1, [0.1, 0.0, 0.0])], "graph string, v long, step array<double>")
    moved = graphs._moved(variables, step)
    assert "Broadcast" not in moved._jdf.queryExecution().executedPlan().toString()
    plan = graphs.linearised(factors, variables, state)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1 and plan.count("SortMergeJoin") >= 2  # what there is by graph may be
