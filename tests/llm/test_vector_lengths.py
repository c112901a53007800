"""Vectors of each length are searched by themselves."""

import pytest

from test_vectors_and_media import brute, vectors
from wayfold.llm import vector_search


@pytest.mark.parametrize("odd", [[], [1.0], [0.5] * 9])
def test_odd_vectors_in_first_place(spark, odd):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], 0) for i in range(50, 120)]
    df = vectors(spark, [(0, odd, 0), *rows]).coalesce(1)
    v = vector_search.scaled(df)
    found = sorted(map(tuple, vector_search.top_k(v, v.where("id % 50 = 0")).collect()))
    assert found == brute(rows) and found


def test_every_length_is_searched(spark):
    rows = [(50, [1.0], 0), (51, [2.0], 0), (100, [1.0, 2.0], 0), (101, [3.0, 4.0], 0)]
    v = vector_search.scaled(vectors(spark, rows))
    assert sorted(map(tuple, vector_search.top_k(v, v.where("id % 50 = 0")).collect())) == sorted([*brute(rows[:2]), *brute(rows[2:])])
