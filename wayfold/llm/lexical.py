"""Ranked lexical search: windows of documents are scored term by term into flat arrays.

One pass over the texts keeps, of each document, its number of terms and how often it holds each asked term. These rows are
ordered by doc_id over range partitions; a task goes through them in windows of ``WINDOW`` documents. In a window the postings
of each term lie together, and an item adds its terms' integer scores to an array as large as the window, which stays in a
core's cache; a set of bits, one for 64 documents, says which parts of it were touched, and only those are harvested
into the item's heap and cleared. A task gives its best k an item; those are ranked once more.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased, over the whole text. Null
texts have none. Documents without id take no part; rows that share an id are documents of their own, as are items.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import slices, small_batches, stash, texts_of

#: Documents of a window: 128 KB of scores.
WINDOW = 16_384
#: Different terms, and items, that are searched for in one pass over the texts; further items take further passes.
ASKED, ITEMS = 250_000, 10_000
#: Bytes of a text that are cut into terms at a time.
PART = 4 << 20
#: Rows of postings of a task.
EACH = 100_000
_TERM, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def parts(raw: bytes, size: int = PART) -> Iterator[bytes]:
    """``raw`` in parts of about ``size`` that end between terms."""
    start = 0
    while start < len(raw):
        gap = _GAP.search(raw, start + size)
        end = gap.end() if gap else len(raw)
        yield raw[start:end]
        start = end


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    for part in parts((text or "").encode().lower()):  # bytes.lower() knows A-Z only
        yield _TERM.findall(part)


def _postings(asked: dict[bytes, int]):
    """Task function: (id, text) -> (id, n, terms, counts): of each document with terms its length and the asked terms in it."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = asked.get
        for batch in slices(batches, column=1):
            at, sizes, held, often = [], [], [], []
            for k, text in enumerate(texts_of(batch.column(1))):
                n, found = 0, Counter()
                for some in terms(text):
                    n += len(some)
                    found.update(map(number, some))
                found.pop(None, None)
                if n:
                    at.append(k)
                    sizes.append(n)
                    held.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                    often.append(np.fromiter(found.values(), np.int64, len(found)).tobytes())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), pa.array(held, pa.binary()), pa.array(often, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "counts"])

    return postings


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: (terms) -> (term, df): in how many documents of the task each term is."""
    df = np.zeros(0, np.int64)
    for batch in batches:
        found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=len(df))
        found[: len(df)] += df
        df = found
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some].astype(np.int64))], ["term", "df"])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with n terms each; whole numbers of any size where 64 bits would not do."""
    if len(n) and 25 * int(n.max()) * docs >= 1 << 63:
        return np.array([75 + 25 * int(x) * docs // total for x in n], np.int64)
    return 75 + 25 * n * docs // total


class Heap:
    """The k best (score, smaller id first) of an item."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int:
        """The least score that can still enter."""
        return self.rows[0][0] if len(self.rows) == self.k else 1

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = scores >= self.floor()
        scores, ids = scores[fit], ids[fit]
        if len(scores) > self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
        for row in zip(scores.tolist(), (-ids).tolist(), strict=True):
            if len(self.rows) < self.k:
                heapq.heappush(self.rows, row)
            elif row > self.rows[0]:
                heapq.heapreplace(self.rows, row)


class Scorer:
    """Items' terms with their weights, against windows of documents."""

    def __init__(self, items: list[list[tuple[int, int]]], docs: int, total: int, k: int):
        """``items``: (term, weight times its occurrences) of each."""
        self.items, self.docs, self.total = items, docs, total
        self.heaps = [Heap(k) for _ in items]
        self.scores = np.zeros(WINDOW, np.int64)
        self.touched = np.zeros(-(-WINDOW // 64), bool)

    def window(self, ids: np.ndarray, n: np.ndarray, held: list[bytes], often: list[bytes]) -> None:
        """Scores at most WINDOW documents."""
        term, tf = np.frombuffer(b"".join(held), np.int32), np.frombuffer(b"".join(often), np.int64)
        slot = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in held])
        m = lengths(n, self.docs, self.total)
        part = 1_000_000_000 * tf // (1000 * tf + 12 * m[slot])
        order = np.argsort(term, kind="stable")
        term, slot, part = term[order], slot[order], part[order]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        lists = {t: (slot[s:e], part[s:e]) for t, s, e in zip(term[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True)}
        scores, touched, near = self.scores, self.touched, np.arange(64)
        for item, heap in zip(self.items, self.heaps, strict=True):
            for t, w in item:
                if t in lists:
                    at, value = lists[t]
                    scores[at] += w * value
                    touched[at >> 6] = True
            groups = np.flatnonzero(touched)
            if len(groups):
                cells = (groups[:, None] * 64 + near).ravel()
                found = scores[cells]
                some = np.flatnonzero(found >= heap.floor())
                heap.take(found[some], ids[cells[some]])
                scores[cells] = 0
                touched[groups] = False


def _scored(items: list[list[tuple[int, int]]], docs: int, total: int, k: int):
    """Task function: (id, n, terms, counts) by id -> (item, id, score): the k best documents of the task for each item."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(items, docs, total, k)
        rows, waiting = 0, []

        def flush() -> None:
            ids, n = (np.concatenate([b.column(c).to_numpy() for b in waiting]) for c in (0, 1))
            held, often = ([x for b in waiting for x in b.column(c).to_pylist()] for c in (2, 3))
            scorer.window(ids, n, held, often)

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                some = batch.slice(start, WINDOW - rows)
                waiting.append(some)
                start, rows = start + some.num_rows, rows + some.num_rows
                if rows == WINDOW:
                    flush()
                    rows, waiting = 0, []
        if waiting:
            flush()
        for i, heap in enumerate(scorer.heaps):
            if heap.rows:
                score, minus = (np.array(x, np.int64) for x in zip(*heap.rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), pa.array(-minus), pa.array(score)], ["item", "id", "score"])

    return scored


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Items with their terms, in blocks of at most ITEMS items and ASKED different terms; one item alone may have more."""
    block, asked = [], set()
    for item_id, text in items.toLocalIterator():
        found = Counter(t for some in terms(text) for t in some)
        if block and (len(block) == ITEMS or len(asked | found.keys()) > ASKED):
            yield block
            block, asked = [], set()
        asked |= found.keys()
        block.append((item_id, found))
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): each item's k documents of highest score above 0, all if fewer; ties to the smaller id.

    With N documents that have terms, L terms in all, n in a document, df documents that hold a term and tf occurrences, the
    score sums w * (10**9 tf div (1000 tf + 12 m)) over the item's terms, repeats included; w = floor(1000 ln((2N + 2) / (2df + 1)))
    and m = 75 + 25 n N div L. Items are the smaller table: ``ASKED`` different terms of them (some 20 MB) are broadcast at a time.
    Empty tables, items without terms and terms that no document holds give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    read = small_batches(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(items.select(item_col, item_text)):
        number = {t: i for i, t in enumerate(sorted(set().union(*(found for _, found in block))))}
        rows = stash(read.mapInArrow(_postings(number), "id long, n long, terms binary, counts binary"), "postings")
        whole = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
        if not whole.docs:
            return out.toDF(item_col, "rank", id_col, "score")
        # one row a term
        df = dict(rows.select("terms").mapInArrow(_held, "term int, df long").groupBy("term").agg(F.sum("df")).collect())
        asked = [[(number[t], weight(whole.docs, df[number[t]]) * often) for t, often in found.items() if number[t] in df] for _, found in block]
        met = rows.where("octet_length(terms) > 0").withColumn("salt", F.xxhash64("terms", "counts", "n"))
        ordered = met.repartitionByRange(max(1, math.ceil(whole.docs / EACH)), "id", "salt").sortWithinPartitions("id").drop("salt")
        best = ordered.mapInArrow(_scored(asked, whole.docs, whole.total, k), "item int, id long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {kind}")
        ranked = best.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "item")
        out = out.unionByName(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"))
    return out.toDF(item_col, "rank", id_col, "score")
