"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from wayfold.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(x, 5) + 0.0 if isinstance(x, float) and math.isfinite(x) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    want = db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.select(want.columns).collect()) == plain(want.fetchall())
