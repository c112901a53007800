"""What a search of recordings broadcasts: some blocks of queries at once, however many recordings there are."""

import numpy as np
import pytest

from wayfold.llm import audio


@pytest.fixture
def small_broadcasts(spark):
    name = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(name)
    spark.conf.set(name, str(40 << 10))
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("n_queries", [9, 30])
def test_broadcasts_do_not_grow_with_blocks(spark, monkeypatch, small_broadcasts, n_queries):
    monkeypatch.setattr(audio, "BLOCK", 66)
    monkeypatch.setattr(audio, "PASS", 8, raising=False)
    rng = np.random.default_rng(8)
    rows = [rng.integers(0, 1 << 32, 33, np.uint32) for _ in range(150)]
    rows += [row[4:] ^ np.uint32(1) for row in rows[:n_queries]]
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(rows)], "id long, items array<long>")
    prints = audio.classes(df).cache()
    cls = {r.id: r.cls for r in prints.collect()}
    found = {(r.q, r.c): (r.offset, r.n) for r in audio.alignments(prints, prints.where(f"id < {n_queries}")).collect()}
    for i in range(n_queries):
        assert found[cls[i], cls[i]] == (0, 33) and found[cls[i], cls[150 + i]] == (4, 29)
