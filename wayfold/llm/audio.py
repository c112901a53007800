"""Chroma fingerprints of audio columns, and the alignment of recordings by them.

Power spectra of overlapping frames are folded to twelve pitch classes. On the integral image of those frames a
set of rectangle filters compares areas, each gives two bits in Gray code, and every step packs them into one
32-bit item. Two recordings are compared bit by bit at every offset at which enough items meet; every right bit is
a vote for the offset and every wrong one against it, and a low error rate aligns them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import slices, small_batches, stash

RATE, FRAME, HOP = 5512, 2048, 512
CLASSES, LOWEST, HIGHEST = 12, 110.0, 1760.0
#: Frames that an item looks at.
SPAN = 8
#: For an alignment: items compared that aren't silent in both, share of wrong bits in them, items that meet.
LEAST_VOTES, MOST_ERRORS, LEAST_ITEMS = 3, 0.25, 8
#: Items of the recordings and of the queries that meet at once.
BLOCK = 1 << 15
#: Blocks of queries that are broadcast at once: 8 MB of items.
PASS = 32
#: Recordings of similar length from which on products of matrices are faster than bits.
FEW = 8


def filters() -> list[tuple[int, int, int, int, int, float]]:
    """(kind, class, classes, frames, first frame, threshold) of the sixteen filters; fixed by this rule.

    Kinds: 0 the area's level against the span's, 1 upper against lower half, 2 earlier against later half,
    3 the inner against the outer thirds.
    """
    out = []
    for k in range(16):
        kind = k % 4
        height = (2, 4, 6, 4)[(k // 4) % 4] if kind == 1 else (1, 2, 3, 4)[(k // 4) % 4]
        width = (8, 4, 6, 6)[kind]
        out.append((kind, (5 * k) % (CLASSES - height + 1), height, width, (3 * k) % (SPAN - width + 1), 0.12 if kind else 0.25))
    return out


_FILTERS = filters()


#: The item of frames without any power: all areas are equal, which is the third of the four levels.
SILENCE = int("11" * 16, 2)


@lru_cache
def _fold(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window, the lines of the spectrum that count, and which pitch class each of them belongs to."""
    freq = np.arange(FRAME // 2 + 1) * rate / FRAME
    use = np.flatnonzero((freq >= LOWEST) & (freq < HIGHEST))
    pitch = np.round(12 * np.log2(freq[use] / 440.0)).astype(int) % CLASSES
    fold = np.zeros((len(use), CLASSES))
    fold[np.arange(len(use)), pitch] = 1
    return np.hanning(FRAME).astype(np.float32), use, fold


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12): the power of each pitch class, each frame scaled to one; silent frames are all zero."""
    window, use, fold = _fold(rate)
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if n <= 0:
        return np.zeros((0, CLASSES))
    lines = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * window, axis=1)[:, use]
    out = (lines.real.astype(np.float64) ** 2 + lines.imag.astype(np.float64) ** 2) @ fold
    size = out.sum(1, keepdims=True)
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0.0)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """32-bit items, one per frame for which SPAN frames are there; none for shorter recordings."""
    c = chroma(samples, rate)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, CLASSES + 1))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(first, frames, low, classes):
        a, b = t + first, t + first + frames
        return image[b, low + classes] - image[a, low + classes] - image[b, low] + image[a, low]

    items = np.zeros(n, np.uint32)
    for kind, low, classes, width, first, threshold in _FILTERS:
        whole = area(first, width, low, classes)
        if kind == 0:
            x, y = whole / (width * classes), area(0, SPAN, 0, CLASSES) / (SPAN * CLASSES)
        elif kind == 1:
            half = max(1, classes // 2)
            x, y = area(first, width, low, half), area(first, width, low + classes - half, half)
        elif kind == 2:
            x, y = area(first, width // 2, low, classes), area(first + width // 2, width // 2, low, classes)
        else:
            inner = area(first + width // 3, width // 3, low, classes)
            x, y = inner, (whole - inner) / 2
        level = np.log1p(20 * x) - np.log1p(20 * y)
        step = np.searchsorted([-threshold, 0.0, threshold], level, "right")
        items = items << np.uint32(2) | (step ^ step >> 1).astype(np.uint32)
    return items


def fingerprints(recordings: DataFrame, id_col: str, samples_col: str, rate: int = RATE) -> DataFrame:
    """(id, items) of a column of samples, array<float> or 16-bit little-endian binary; null gives no items."""
    packed = dict(recordings.dtypes)[samples_col] == "binary"

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            rows = []
            for x in batch.column(1):
                v = np.zeros(0, np.float32)
                if x.is_valid:
                    v = np.frombuffer(x.as_buffer(), "<i2") / np.float32(32768) if packed else np.nan_to_num(x.values.to_numpy(zero_copy_only=False).astype(np.float32), posinf=0, neginf=0)
                rows.append(fingerprint(v, rate).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["id", "items"])

    chosen = recordings.select(F.col(id_col).alias("id"), samples_col)
    return chosen.mapInArrow(printed, f"id {chosen.schema[0].dataType.simpleString()}, items array<long>")


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seconds: float = 4.0) -> DataFrame:
    """(id, samples): a recording of each vector as 16-bit samples: each pair of components plays a two-note chord.

    Null vectors give null; components that are null or not finite are rests.
    """
    size = int(seconds * RATE)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(size) / RATE
        for batch in slices(batches, 200):
            out = []
            for x in batch.column(1):
                if not x.is_valid or not len(x.values):
                    out.append(None if not x.is_valid else b"")
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                v = v[: len(v) // 2 * 2].reshape(-1, 2) if len(v) > 1 else np.repeat(v, 2)[None]
                fine = np.isfinite(v).all(1)
                note = np.round(np.clip(np.nan_to_num(v, posinf=0, neginf=0), -1, 1) * 36)
                at = np.minimum((t * len(v) / seconds).astype(int), len(v) - 1)
                freq = 440.0 * 2.0 ** (np.clip(note, -24, 23) / 12)
                wave = (np.sin(2 * np.pi * np.cumsum(freq[at, 0]) / RATE) + np.sin(2 * np.pi * np.cumsum(freq[at, 1]) / RATE)) * 0.4 * fine[at]
                out.append((wave * 32767).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "samples"])

    chosen = vectors.select(F.col(id_col).alias("id"), vector_col)
    return chosen.mapInArrow(render, f"id {chosen.schema[0].dataType.simpleString()}, samples binary")


def best_offsets(asked: list[np.ndarray], many: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(which of ``asked``, which of ``many``, offset, items that meet, share of wrong bits) of those that align, at the best offset.

    Item k of the other meets the asked one's item k + offset. All offsets are tried. The best one has the most right bits
    less wrong ones; of equal ones the nearest to 0, then the larger. Items that are silent in both count as neither.
    """
    out = [tuple(np.zeros(0, np.int64) for _ in range(5))]
    for these in _alike(asked):
        for those in _alike(many):
            some = [many[i] for i in those]
            if min(len(these), len(those)) >= FEW and max(len(asked[these[-1]]), len(some[-1])) <= BLOCK:
                row, column, *rest = _products([asked[i] for i in these], some)
                out.append((these[row], those[column], *rest))
                continue
            size = np.array([len(x) for x in some])
            for i in these:
                which, *rest = _best_offsets(asked[i], some, size, those)
                out.append((np.full(len(which), i), which, *rest))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _alike(many: list[np.ndarray]) -> list[np.ndarray]:
    """Places of recordings of similar length, shorter ones first, which fit one table."""
    size = np.array([len(x) for x in many])
    order, out = np.argsort(size, kind="stable"), []
    while len(order):
        near = int(np.searchsorted(size[order], max(1, size[order[0]]) * 1.5, "right"))
        out.append(order[:near])
        order = order[near:]
    return out


def _signs(many: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(recordings, 32 * longest): each bit as 1 or -1, 0 where a recording has ended; and (recordings, longest): 1 for silent items."""
    items, there = np.zeros((len(many), longest), "<u4"), np.zeros((len(many), longest), bool)
    for i, x in enumerate(many):
        items[i, : len(x)], there[i, : len(x)] = x, True
    bits = np.unpackbits(items.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    return bits * np.repeat(there, 32, axis=1), (there & (items == SILENCE)).astype(np.float32)


def _products(asked: list[np.ndarray], many: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """:func:`best_offsets` of many with many: a product of signs is right bits less wrong ones, exact below 2 ** 24."""
    size_a, size = (np.array([len(x) for x in y]) for y in (asked, many))
    here, longest = int(size_a.max()), int(size.max())
    (a, quiet_a), (c, quiet) = _signs(asked, here), _signs(many, longest)
    c, quiet = np.ascontiguousarray(c.T), np.ascontiguousarray(quiet.T)
    silent = quiet_a.any() and quiet.any()
    even = size_a.min() == here and size.min() == longest
    best = np.full((len(asked), len(many)), -np.inf, np.float32)
    offset, n_best, told_best = np.zeros((3, *best.shape), np.int32)
    for o in sorted(range(LEAST_ITEMS - longest, here - LEAST_ITEMS + 1), key=lambda o: (abs(o), -o)):
        lo, hi = max(0, o), min(here, longest + o)
        gain = a[:, 32 * lo : 32 * hi] @ c[32 * (lo - o) : 32 * (hi - o)]
        n = hi - lo if even else np.minimum(size_a[:, None], size + o) - lo
        told = n
        if silent:
            both = quiet_a[:, lo:hi] @ quiet[lo - o : hi - o]
            gain -= 32 * both
            told = n - both.astype(np.int32)
        found = np.nonzero((gain > best) & (gain >= 32 * (1 - 2 * MOST_ERRORS) * told - 1))
        n, told = (np.broadcast_to(x, best.shape)[found].astype(np.int64) for x in (n, told))
        right = (n >= LEAST_ITEMS) & (told >= LEAST_VOTES) & (16 * told - gain[found] / 2 <= MOST_ERRORS * 32 * told)
        found = tuple(x[right] for x in found)
        best[found], offset[found], n_best[found], told_best[found] = gain[found], o, n[right], told[right]
    row, column = np.nonzero(n_best)
    told = told_best[row, column].astype(np.int64)
    return row, column, offset[row, column].astype(np.int64), n_best[row, column].astype(np.int64), (16 * told - best[row, column].astype(np.int64) // 2) / (32 * told)


def _best_offsets(a: np.ndarray, many: list[np.ndarray], size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """:func:`best_offsets` of one with many, without the first column; bit by bit, which also takes long recordings."""
    longest = int(size.max())
    table = np.zeros((longest, len(many)), np.uint32)
    for i, b in enumerate(many):
        table[: len(b), i] = b
    there = None if size.min() == longest else np.arange(longest)[:, None] < size
    quiet_a, quiet = a == SILENCE, table == SILENCE
    silent = quiet_a.any() and quiet.any()
    total = np.uint16 if 32 * min(len(a), longest) < 1 << 16 else np.uint32
    best, offset, n_best, wrong_best, told_best = np.full(len(many), np.iinfo(np.int64).min), *np.zeros((4, len(many)), np.int64)
    offsets = range(LEAST_ITEMS - longest, len(a) - LEAST_ITEMS + 1)
    for o in sorted(offsets, key=lambda o: (abs(o), -o)):
        lo, hi = max(0, o), min(len(a), longest + o)
        bits = np.bitwise_count(a[lo:hi, None] ^ table[lo - o : hi - o])
        if there is not None:
            bits *= there[lo - o : hi - o]
        wrong = bits.sum(0, dtype=total).astype(np.int64)
        n = np.minimum(len(a), size + o) - lo
        told = n - (quiet_a[lo:hi, None] & quiet[lo - o : hi - o]).sum(0) if silent else n
        gain = 32 * told - 2 * wrong
        better = np.flatnonzero((gain > best) & (n >= LEAST_ITEMS) & (told >= LEAST_VOTES) & (wrong <= MOST_ERRORS * 32 * told))
        for x, y in ((best, gain), (offset, np.full(len(many), o)), (n_best, n), (wrong_best, wrong), (told_best, told)):
            x[better] = y[better]
    found = np.flatnonzero(n_best)
    return at[found], offset[found], n_best[found], wrong_best[found] / (32 * told_best[found])


def classes(prints: DataFrame) -> DataFrame:
    """``prints`` (id, items) with cls, a 64-bit hash of the items; null where there are none."""
    return prints.withColumn("cls", F.when(F.size("items") > 0, F.xxhash64("items")))


def _packed(prints: DataFrame, k: str, carried: Sequence[str] = ()) -> tuple[int, DataFrame]:
    """The number of blocks, and ``prints`` (cls, items) as one row for each: (block, classes, sizes, items of all, columns carried along), named after ``k``."""
    total = prints.agg(F.sum(F.size("items"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    rows = prints.groupBy(F.pmod("cls", F.lit(blocks)).cast("int").alias(f"{k}_block")).agg(F.collect_list(F.struct("cls", "items", *carried)).alias("r"))
    return blocks, rows.select(f"{k}_block", F.col("r.cls").alias(k), F.transform("r.items", F.size).alias(f"{k}_sizes"), F.flatten("r.items").alias(f"{k}_items"), *[f"r.{x}" for x in carried])


def _unpacked(sizes: pa.ListScalar, items: pa.ListScalar) -> list[np.ndarray]:
    return np.split(items.values.to_numpy().astype(np.uint32), np.cumsum(sizes.values.to_numpy())[:-1])


def alignments(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, c, offset, n, rate, query): for the class of each query the classes that align with it, its own with offset 0.

    ``query`` is the smallest id among the queries of class ``q``.

    ``prints`` has (id, items, cls), ``queries`` some of its rows. Recordings with equal items are one class and
    meet once. Every query class is compared with every class at every offset, block by block, so nothing that is
    close enough is missed (see :func:`best_offsets`). Recordings without items align with nothing.

    Queries are broadcast, at most PASS blocks of them at once; the recordings stay where they are. What the passes
    find is written where there are several, so that one broadcast is gone before the next.
    """
    reps = stash(prints.where("cls is not null").groupBy("cls").agg(F.min_by("items", "id").alias("items")), "classes")
    asked = queries.where("cls is not null").groupBy("cls").agg(F.min_by("items", "id").alias("items"), F.min("id").alias("query"))
    blocks, file = _packed(reps, "c")
    groups, wanted = _packed(asked, "q", ["query"])
    file, wanted = stash(file, "recordings").repartition(min(blocks, 2000), "c_block"), stash(wanted, "queries")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, c_sizes, c_items, q, q_sizes, q_items, query in zip(*(batch.column(k) for k in ("c", "c_sizes", "c_items", "q", "q_sizes", "q_items", "query")), strict=True):
                names, others = q.values.to_numpy(), c.values.to_numpy()
                which, other, offset, n, rate = best_offsets(_unpacked(q_sizes, q_items), _unpacked(c_sizes, c_items))
                new = names[which] != others[other]
                which, other = which[new], other[new]
                columns = [names[which], others[other], offset[new].astype(np.int32), n[new], rate[new]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), query.values.take(pa.array(which))], ["q", "c", "offset", "n", "rate", "query"])

    def found(first: int) -> DataFrame:
        some = wanted.where(F.col("q_block").between(first, first + PASS - 1))
        met = small_batches(file.crossJoin(F.broadcast(some)))
        return met.mapInArrow(compared, f"q long, c long, offset int, n long, rate double, query {asked.schema['query'].dataType.simpleString()}")

    parts = [found(0)] if groups <= PASS else [stash(found(first), "alignments") for first in range(0, groups, PASS)]
    same = asked.select(F.col("cls").alias("q"), F.col("cls").alias("c"), F.lit(0).alias("offset"), F.size("items").cast("long").alias("n"), F.lit(0.0).alias("rate"), "query")
    return reduce(DataFrame.unionByName, parts, same)


def aligned(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100) -> DataFrame:
    """(id, n_items, items_crc32, cls, n_queries, first_query, offset, error_rate) for every row of ``vectors``.

    Queries are the recordings whose id is divisible by ``every``; all recordings are searched. ``n_queries`` counts
    the query classes that a recording aligns with, ``first_query`` is the smallest id among them, with its offset
    and error rate; null where there is none. Null, empty and short recordings have no items and align with nothing.
    Repeated rows, and rows that share an id, are recordings of their own; equal recordings are one class. An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    prints = stash(classes(fingerprints(rendered(vectors, id_col, vector_col), "id", "samples")), "prints")
    met = alignments(prints, prints.where(F.col("id") % every == 0)).groupBy(F.col("c").alias("cls"))
    best = [F.min_by(k, "query").alias(k) for k in ("offset", "rate")]
    matches = stash(met.agg(F.count("*").alias("n_queries"), F.min("query").alias("first_query"), *best), "matches")
    raw = F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).cast("binary")
    rows = prints.select("id", F.size("items").cast("long").alias("n_items"), F.crc32(raw).alias("items_crc32"), "cls")
    return rows.join(matches.hint("merge"), "cls", "left").select(  # nearly every recording has a match, so they aren't broadcast
        F.col("id").alias(id_col),
        "n_items",
        "items_crc32",
        "cls",
        F.coalesce("n_queries", F.lit(0)).alias("n_queries"),
        "first_query",
        "offset",
        F.round("rate", 6).alias("error_rate"),
    )
