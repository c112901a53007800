"""Means of doubles whose rounding hangs on the order of their sum, over a file that Spark reads in many parts."""

import duckdb
import numpy as np
import pytest

from wayfold.operators import stats
from wayfold.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture
def small_parts(spark):
    new = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_best_config_over_many_row_groups(spark, small_parts, tmp_path):
    rng = np.random.default_rng(6)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    rows = [(int(s), "ANR"[i % 3], int(rng.integers(0, 11)) / 100) for i in range(192) for s in rng.permutation(150)]
    con.execute("CREATE TABLE t AS SELECT unnest($1) AS l_suppkey, unnest($2) AS l_returnflag, unnest($3) AS l_discount", [list(x) for x in zip(*rows, strict=True)])
    con.execute(f"COPY t TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df = QUERIES["best_config"](spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() > 5
    assert sorted(map(tuple, df.select("sequence", "config", "mean").collect())) == sorted(con.sql(ORACLE_SQL["best_config"]).fetchall())


def test_equal_means_and_odd_values(spark):
    x = [(0, "b", 0.1), (0, "b", 0.2), (0, "a", 0.3), (0, "a", 0.0), (1, "a", None), (1, "b", 0.5), (2, "a", float("nan")), (2, "b", float("inf")), (3, "a", None), (None, "a", 0.25), (4, "a", 1e308), (4, "a", 1e308), (4, "b", 2.0)]
    df = spark.createDataFrame([(s, c, v, i) for i, (s, c, v) in enumerate(x)], "s long, c string, v double, i long").repartition(7)
    found = {r.s: (r.c, r.mean) for r in stats.best_mean(df, ["s"], "c", "v", ["i"], 6).collect()}
    assert found == {0: ("a", 0.15), 1: ("b", 0.5), 2: ("b", float("inf")), None: ("a", 0.25), 4: ("b", 2.0)}
