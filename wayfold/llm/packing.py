"""Best-fit packing of token sequences, planned on the histogram of lengths.

Only the histogram (at most ``capacity`` numbers) reaches the driver. Best-fit decreasing runs on counts: all
pieces of one length are placed at once, into ranges of equally full sequences. Pieces then take the planned
slots by their rank within their length, which comes from their rank in the task that cut them.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm import bpe
from wayfold.llm.common import frugal, slices, small_batches, stash, texts_of

CACHED = 400_000
CAPACITY = 2048
#: The id that ends each document.
END = (0).to_bytes(4, "little")


@dataclass(frozen=True)
class Plan:
    """Slots for pieces of one length: ranks from ``first[i]`` on go into sequences from ``sequence[i]`` on, ``each[i]`` apiece."""

    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, Plan], int]:
    """Best-fit decreasing over counts: the plan for each length, and the number of sequences.

    Placing equal pieces one by one, best-fit fills one sequence with as many as it holds before it takes
    the next equally full one; so a range of equally full sequences is dealt with in one step.
    """
    open_ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges of sequences
    plans: dict[int, Plan] = {}
    made = 0
    for length in sorted(histogram, reverse=True):
        left, rank, steps = histogram[length], 0, []
        moved: list[tuple[int, tuple[int, int]]] = []
        for room in sorted(r for r in open_ranges if r >= length):
            each = room // length
            while left and open_ranges[room]:
                start, n = open_ranges[room].pop()
                take = min(left, n * each)
                full, rest = divmod(take, each)
                steps.append((rank, start, each, capacity - room))
                moved.append((room - each * length, (start, full)))
                moved.append((room - rest * length, (start + full, 1 if rest else 0)))
                used = full + (rest > 0)
                moved.append((room, (start + used, n - used)))
                rank, left = rank + take, left - take
            if not left:
                break
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            steps.append((rank, made, each, 0))
            moved.append((capacity - each * length, (made, full)))
            moved.append((capacity - rest * length, (made + full, 1 if rest else 0)))
            made += full + (rest > 0)
        for room, (start, n) in moved:
            if n and room:
                open_ranges[room].append((start, n))
        plans[length] = Plan(*(np.asarray(x, np.int64) for x in zip(*steps, strict=True)))
    return plans, made


def _cut(capacity: int):
    """Task function: (id, text) -> pieces with their checksum and their rank in this task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks = TaskContext.get().partitionId(), Counter()
        ids_of = bpe.BoundedCache(bpe.packed, CACHED)
        for batch in slices(batches, column=1):
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                ids = b"".join(map(ids_of.__getitem__, bpe.runs(text))) + END if text else END
                total = len(ids) // 4
                first = total % capacity or capacity
                at = 0
                for k, end in enumerate(range(first, total + 1, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * end]))
                    rank.append(ranks[end - at])
                    ranks[end - at] += 1
                    at = end
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    pa.array([task] * len(row), pa.int32()),
                    pa.array(rank, pa.int64()),
                ],
                ["id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    return cut


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece that holds the end id alone. Documents longer than ``capacity`` ids are
    cut, the remainder first. Equal lengths are told apart by rank, so ties and repeated rows each get a slot
    of their own. An empty table gives no rows. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema[0].dataType.simpleString()
    # ranks count within a task, so they hold only for the rows as this table keeps them
    pieces = stash(
        small_batches(chosen).mapInArrow(frugal(_cut(capacity)), f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"),
        "pieces",
    )
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plans, _ = best_fit(histogram, capacity)
    planned = spark.sparkContext.broadcast(plans)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, bounds) if len(order) else ():
                p, size = planned.value[int(length[rows[0]])], length[rows[0]]
                i = np.searchsorted(p.first, rank[rows], "right") - 1
                within = rank[rows] - p.first[i]
                sequence[rows] = p.sequence[i] + within // p.each[i]
                offset[rows] = p.offset[i] + within % p.each[i] * size
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in names), pa.array(sequence), pa.array(offset)],
                [id_col, *names[1:], "sequence_id", "offset"],
            )

    ranked = pieces.join(base, ["length", "task"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")
    )
    return ranked.mapInArrow(
        placed, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
