"""Queries over whole tables: ids and counts that small tables don't have."""

import math

import duckdb
import numpy as np
import pytest

from test_queries import plain
from wayfold.operators import spatial, voxel
from wayfold.plans.registry import ORACLE_SQL, QUERIES

RUNS = (3, 25, 500, 70_001)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Tables whose runs, orders and parts go far beyond those of the smallest ones."""
    d = tmp_path_factory.mktemp("wide")
    rng = np.random.default_rng(3)
    con = duckdb.connect()
    kinds = ("purchase", "error", "view")
    events = [(i, i * 1000, RUNS[i % 4], kinds[int(rng.integers(3))], round(float(rng.uniform(0, 200)), 2), int(rng.integers(0, 40))) for i in range(240)]
    con.execute("CREATE TABLE t (event_id BIGINT, us BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE, k INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", events)
    made = {
        "events": "SELECT event_id, make_timestamp(us) AS ts, user_id, event_type, value, '{\"k\": ' || k || '}' AS props FROM t",
        "lineitem": "SELECT CAST(i * 1777 AS BIGINT) AS l_orderkey, CAST(i % 6 + 1 AS INTEGER) AS l_linenumber FROM range(1, 200) t(i)",
        "part": "SELECT CAST(i AS BIGINT) AS p_partkey FROM range(30, 5000) t(i)",
        "embeddings": "SELECT CAST(i AS BIGINT) AS vec_id FROM range(60) t(i)",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return str(d), con, events


@pytest.mark.parametrize("name", ["radius_seed_join_all", "ray_obstacle_min_all", "dilate_all", "exact_stamp_parse_all", "ray_integration_all"])
def test_whole_query(spark, wide, name):
    d, con, _ = wide
    df = QUERIES[name](spark, d)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.select(want.columns).collect()) == plain(want.fetchall())


def test_nothing_is_left_out(spark, wide):
    d, _, events = wide
    assert {r.run_id for r in QUERIES["dilate_all"](spark, d).select("run_id").distinct().collect()} == set(RUNS)
    assert QUERIES["exact_stamp_parse_all"](spark, d).count() == 199
    seen = {r.event_id for r in QUERIES["ray_integration_all"](spark, d).select("event_id").distinct().collect()}
    assert seen == {i for i, _, _, _, v, k in events if math.hypot(v / 50, k / 10, k % 7 / 4) >= 1e-9}


def test_seeds_against_brute_force(spark, wide):
    d, _, events = wide
    place = lambda e: (e[4] / 50, e[5] / 10, e[5] / 20)
    want = {}
    for q in (e for e in events if e[3] == "purchase"):
        x, y, t = place(q)
        tried = []
        for a in (e for e in events if e[3] == "error" and e[2] == q[2]):
            ax, ay, at = place(a)
            if math.hypot(x - ax, y - ay) <= 1:
                for n, dx, dy, dt in spatial.seeds(0.5, 0.12):
                    turn = math.remainder(t + dt - at, 2 * math.pi)
                    tried.append((-round(math.exp(-((x + dx - ax) ** 2 + (y + dy - ay) ** 2 + turn**2)), 9), a[0], n))
        if tried:
            want[q[0]] = min(tried)
    found = {r.event_id: r for r in QUERIES["radius_seed_join_all"](spark, d).collect()}
    assert {r for r in found} == set(want) and {next(e[2] for e in events if e[0] == i) for i in found} == set(RUNS)
    assert all((found[i].anchor, found[i].seed) == (a, n) and math.isclose(found[i].score, -s, abs_tol=2e-6) for i, (s, a, n) in want.items())


@pytest.mark.parametrize("n", [1, 4, 5, 6, 40])
def test_means_beyond_the_cap(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k, i, float(rng.normal())) for k in (0, None) for i in rng.permutation(n).tolist()] + [(1, 0, 7.0)]
    df = spark.createDataFrame(rows, "k int, t int, obs double")
    want = {}
    for k in (0, 1, None):
        mean, weight = 0.0, 0
        for _, x in sorted((t, x) for key, t, x in rows if key == k):
            mean, weight = mean + (x - mean) / (weight + 1), min(weight + 1, 4)
        want[k] = mean, weight
    found = {r.k: (r.tsdf, r.weight) for r in voxel.fused(df, ["k"], cap=4, order=["t"]).collect()}
    assert set(found) == set(want) and all(math.isclose(found[k][0], m, abs_tol=1e-12) and found[k][1] == w for k, (m, w) in want.items())


def test_colours_beyond_the_cap(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, make_timestamp((i * 7919) % 500 * 1000) AS ts, 5 AS user_id, 'view' AS event_type, (i * 37 % 25)::DOUBLE AS value, '{{\"k\": 52}}' AS props FROM range(500) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    rows = sorted((i * 7919 % 500, (i * 37 % 25 / 490.02 - 0.5) * 255) for i in range(500))
    mean, n = 0.0, 0
    for _, x in rows:
        mean, n = mean + (x - mean) / (n + 1), min(n + 1, 32)
    (found,) = QUERIES["colour_mean_folded"](spark, str(tmp_path)).collect()
    (want,) = con.sql(ORACLE_SQL["colour_mean_folded"]).fetchall()
    assert math.isclose(found.red, mean, abs_tol=1e-4) and math.isclose(want[3], mean, abs_tol=1e-4)
