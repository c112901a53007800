"""Blocks of queries, of the file and exact vectors don't go through the driver as broadcasts."""

import numpy as np

from wayfold.llm import vector_search


def test_no_block_is_broadcast(spark):
    rows = [(i, [int(i % 7), int(i % 5)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "id long, v array<long>")
    file = vector_search.packed(vectors, 10, 40, np.array([[0.0, 4.0, 7.0], [0.0, 3.0, 5.0]]))
    asked = vector_search.packed(vectors.where("id % 10 = 0"), 2, 4).selectExpr("block AS group", "ids AS qids", "packed AS q")
    served = spark.createDataFrame([(0, 0, {0: 1.0})], "block int, group int, limits map<long, double>")
    pairs = spark.createDataFrame([(0, 1), (10, 3)], "query long, id long")
    met = vector_search._met(file, asked, 4)
    assert met.count() == file.count() * asked.count()
    found = vector_search._scored(pairs, vectors, vectors.where("id % 10 = 0"))
    assert sorted(map(tuple, found.collect())) == [(0, 1, 0), (10, 3, 9)]
    for df in (met, vector_search._met_again(served, file, asked), found):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
