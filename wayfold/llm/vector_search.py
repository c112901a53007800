"""Exact top-k by inner product over a vector-approximation file.

The file keeps each component as the number of one of 64 cells, apart from the exact vectors. From the middles of the
cells a product is known but for a slack, the same for all vectors, that the cells' widths and the query give. Queries
and blocks of the file meet once; that gives the k-th best bound of each query and the blocks that can reach it. Only
in those are vectors picked whose upper bound reaches it, and of those the exact vectors are read: first the k with
the best bounds, then those whose bound is not below the k-th exact product, which makes the result certain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import stash

#: Vectors of a block of the file and queries that meet at once, and rows of it whose products are held at a time.
BLOCK, QUERIES, PART = 16_384, 512, 2048
CELLS = 64


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): each component as floor(scale * x). Rows without id or components, or with null or non-finite ones, are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).where(fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def _blocks(edges: np.ndarray | None):
    """Task function: (block, ids, vectors flat) -> the vectors as cells, where ``edges`` are given, or as exact numbers."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for n, flat in zip(batch.column(1), batch.column(2), strict=True):
                v = flat.values.to_numpy().reshape(len(n), -1)
                if edges is None:
                    packed.append(v.astype("<i8").tobytes())
                else:
                    packed.append(np.stack([np.searchsorted(e[1:-1], c, "right") for e, c in zip(edges, v.T, strict=True)], 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["block", "ids", "packed"])

    return blocks


def packed(numbered: DataFrame, size: int, count: int, edges: np.ndarray | None = None) -> DataFrame:
    """(block, ids, packed): ``numbered`` (id, v) dealt into ``ceil(count / size)`` blocks by a hash of the id."""
    blocks = max(1, math.ceil(count / size))
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    rows = dealt.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("r"))
    flat = rows.select("block", F.col("r.id").alias("ids"), F.flatten("r.v").alias("flat"))
    return flat.mapInArrow(_blocks(edges), "block int, ids array<long>, packed binary")


def cell_edges(numbered: DataFrame, dims: int) -> np.ndarray:
    """Edges of the cells of each dimension, from its least to its greatest number: whole numbers, CELLS + 1 of them."""
    found = numbered.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return np.array([np.floor(np.linspace(found[f"lo{i}"], found[f"hi{i}"] + 1, CELLS + 1)) for i in range(dims)])


class Cells:
    """Middles of the cells, and how far a number can be from its cell's middle, by dimension."""

    def __init__(self, edges: np.ndarray):
        self.middle = (edges[:, :-1] + np.maximum(edges[:, 1:] - 1, edges[:, :-1])) / 2
        self.half = (np.maximum(edges[:, 1:] - 1, edges[:, :-1]) - edges[:, :-1]).max(1) / 2
        self.at = np.arange(len(edges))

    def products(self, raw: pa.Buffer, n: int, q: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, products of the middles with the queries), some rows at a time."""
        cells = np.frombuffer(raw, np.uint8).reshape(n, -1)
        for i in range(0, n, PART):
            yield i, self.middle[self.at, cells[i : i + PART]] @ q.T

    def slack(self, q: np.ndarray) -> np.ndarray:
        """How far each query's products can be from those of the middles; for sums beyond 2**53 with the rounding."""
        top = np.abs(self.middle).max(1) + self.half
        return np.abs(q) @ self.half + 1e-12 * (np.abs(q) @ top)


def _numbers(raw: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(n, -1).astype(np.float64)


def _bests(edges: np.ndarray, k: int):
    """Task function: a block of the file and one of queries -> (query, group, block, slack, best): the k best products of the middles."""

    def bests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(edges)
        for batch in batches:
            for block, ids, raw, group, qids, q in zip(*(batch.column(c) for c in ("block", "ids", "packed", "group", "qids", "q")), strict=True):
                ids, qids = ids.values.to_numpy(), qids.values.to_numpy()
                q = _numbers(q.as_buffer(), len(qids))
                best = np.full((0, len(qids)), -np.inf)
                for i, found in cells.products(raw.as_buffer(), len(ids), q):
                    found[ids[i : i + PART, None] == qids] = -np.inf
                    found = np.concatenate([best, found])
                    best = np.partition(found, len(found) - k, 0)[-k:] if len(found) > k else found
                rows = [x[np.isfinite(x)].tolist() for x in np.sort(best, 0)[::-1].T]
                same = [pa.array(np.full(len(qids), x.as_py(), np.int32)) for x in (group, block)]
                yield pa.RecordBatch.from_arrays([pa.array(qids), *same, pa.array(cells.slack(q)), pa.array(rows, pa.list_(pa.float64()))], ["query", "group", "block", "slack", "best"])

    return bests


def _picked(edges: np.ndarray):
    """Task function: a block of the file and the queries that it may serve -> (query, id, bound) of vectors that may be among the best."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(edges)
        for batch in batches:
            for ids, raw, qids, q, limits in zip(*(batch.column(c) for c in ("ids", "packed", "qids", "q", "limits")), strict=True):
                ids, qids = ids.values.to_numpy(), qids.values.to_numpy()
                known = dict(limits.as_py())
                at = np.flatnonzero([x in known for x in qids.tolist()])
                q, qids = _numbers(q.as_buffer(), len(qids))[at], qids[at]
                limit, slack = np.array([known[x] for x in qids.tolist()]), cells.slack(q)
                for i, found in cells.products(raw.as_buffer(), len(ids), q):
                    row, column = np.nonzero((found >= limit) & (ids[i : i + PART, None] != qids))
                    columns = [qids[column], ids[i + row], found[row, column] + slack[column]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query", "id", "bound"])

    return picked


def _met(file: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """Every block of the file beside every block of queries. Queries are dealt to the file's blocks by a shuffle: a copy for each of them is too large to broadcast."""
    everywhere = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return file.hint("merge").join(everywhere, "block")


def _met_again(served: DataFrame, file: DataFrame, asked: DataFrame) -> DataFrame:
    """The blocks that ``served`` (block, group, limits) names, beside their queries; these go to the larger blocks of the file."""
    return served.join(asked.hint("merge"), "group").join(file.hint("merge"), "block").select("ids", "packed", "qids", "q", "limits")


def _scored(pairs: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, score) of pairs (query, id): the exact vectors of those ids are read."""
    asked = queries.select(F.col("id").alias("query"), F.col("v").alias("q"))
    met = pairs.select("query", "id").join(exact.hint("merge"), "id").join(asked.hint("merge"), "query")
    score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return met.select("query", "id", score.alias("score"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over ``vectors`` but its own row.

    Both tables are (id, v) with whole numbers. Only vectors of one length have a product, so each length is searched by
    itself, one after another; null and empty vectors are left out. Ties go to the smaller id; where fewer than k other vectors of its
    length exist, a query gets all of them. Ids are unique, but repeated vectors are vectors of their own. An empty table gives
    no rows; other columns are not read.
    """
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = {r.n for r in queries.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().collect()}
    for r in sorted(vectors.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().collect()):
        if r.n in asked:
            found = found.unionByName(_top_k(vectors, queries, r.n, r["count"], k))
    return found


def _top_k(vectors: DataFrame, queries: DataFrame, dims: int, n: int, k: int) -> DataFrame:
    """:func:`top_k` over the ``n`` vectors of one length."""
    queries = queries.where(F.size("v") == dims)
    m = queries.count()
    exact = stash(vectors.where(F.size("v") == dims).select("id", "v"), "exact")
    edges = cell_edges(exact, dims)
    file = stash(packed(exact, BLOCK, n, edges), "cells")
    asked = stash(packed(queries, QUERIES, m).select(F.col("block").alias("group"), F.col("ids").alias("qids"), F.col("packed").alias("q")), "queries")
    blocks = max(1, math.ceil(n / BLOCK))
    # a stated set of queries against all rows, block by block
    bests = stash(_met(file, asked, blocks).mapInArrow(_bests(edges, k), "query long, group int, block int, slack double, best array<double>"), "bests")
    kth = F.sort_array(F.flatten(F.collect_list("best")), asc=False)
    floors = bests.groupBy("query").agg(kth.alias("best")).select("query", F.coalesce(F.get("best", F.lit(k - 1)), F.lit(float("-inf"))).alias("kth"))
    limit = F.col("kth") - 2 * F.col("slack")
    near = bests.hint("merge").join(floors, "query").where((F.size("best") > 0) & (F.get("best", F.lit(0)) >= limit))
    served = near.groupBy("block", "group").agg(F.map_from_entries(F.collect_list(F.struct("query", limit))).alias("limits"))
    picked = stash(_met_again(served, file, asked).mapInArrow(_picked(edges), "query long, id long, bound double"), "picked")
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "id")
    ranked = picked.withColumn("place", F.row_number().over(by_bound))
    first = stash(_scored(ranked.where(F.col("place") <= k), exact, queries), "first")
    sure = first.groupBy("query").agg(F.min("score").alias("sure"))
    rest = ranked.where(F.col("place") > k).join(sure, "query").where("bound >= sure")
    found = first.unionByName(_scored(rest, exact, queries))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
