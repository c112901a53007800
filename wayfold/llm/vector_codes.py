"""Vectors as short codes: each part of a vector becomes the number of its nearest codebook entry, after Elkan's Lloyd rounds.

Vectors are kept in packed blocks as they are read, without any shuffle. A block keeps, beside its whole numbers, for each part
the entry it is assigned to, an upper bound of the distance to it and a lower bound of the distance to each entry, and is
written after each round. When entries move, upper bounds grow by their entry's way and lower bounds shrink by theirs. An entry is
left out only where its lower bound, or half its distance from the assigned one, is strictly above the upper bound;
what remains is compared by whole squared distances, ties to the lower number, so codes are those of the plain rounds.
Bounds are floats, rounded away from pruning; lower ones are written with 16 bits. Sums and counts by part and entry are aggregated by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import discard, stash

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a block; their lower bounds are PARTS x ENTRIES x 2 bytes each.
BLOCK = 512
#: Bytes of codebooks that tasks hold at a time; widths beyond it take passes of their own.
BOOKS_BYTES = 64 << 20
#: A label with at least this share of all rows is hot; there are no more of them than its inverse.
HOT = 1 / 64
#: Relative error of a rounded root, and of adding in 32 bits.
SLACK = 1e-6
_STATE = "width int, size int, ids binary, labels binary, unlabelled binary, vectors binary, near binary, upper binary, lower binary"
Books = dict[int, list[np.ndarray]]


def part_ends(width: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin and end: equal ones, or, if they can't be, the first ones longer by one."""
    each, more = divmod(width, parts)
    return [k * each + min(k, more) for k in range(parts + 1)]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows, as 64-bit whole numbers."""
    return (x**2).sum(1)[:, None] - 2 * (x @ entries.T) + (entries**2).sum(1)


def up(d: np.ndarray) -> np.ndarray:
    return (d * (1 + SLACK)).astype(np.float32)


def down(d: np.ndarray) -> np.ndarray:
    return (d * (1 - SLACK)).astype(np.float32)


def kept(lower: np.ndarray) -> np.ndarray:
    """Lower bounds as they are written: 16-bit floats, which have 11 binary digits, below what was known."""
    x = np.minimum(lower * (1 - 2.0**-10), 65_000.0)
    return np.where(x < 2.0**-12, 0.0, x).astype(np.float16)


def assigned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, upper bounds, lower bounds) of the rows of one part, from all distances."""
    d2 = squares(x, entries)
    near = d2.argmin(1)
    d = np.sqrt(d2)
    return near.astype(np.uint8), up(d[np.arange(len(x)), near]), down(d)


def moved(near: np.ndarray, upper: np.ndarray, lower: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after each entry went its ``way``."""
    return up(upper.astype(float) + way[near]), down(np.maximum(lower.astype(float) - way * (1 + SLACK), 0.0))


def reassigned(x: np.ndarray, entries: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest, upper, lower, distances computed) of the rows of one part, by the bounds; these arrays are not changed."""
    near, upper, lower = near.astype(np.int64), upper.copy(), lower.copy()
    half = down(np.sqrt(squares(entries, entries)) / 2)
    open_ = (lower <= upper[:, None]) & (half[near] <= upper[:, None])
    open_[np.arange(len(x)), near] = False
    rows = np.flatnonzero(open_.any(1))
    done = len(rows)
    own = ((x[rows] - entries[near[rows]]) ** 2).sum(1)  # tighten the upper bounds, then look again
    upper[rows] = up(np.sqrt(own))
    lower[rows, near[rows]] = down(np.sqrt(own))
    open_[rows] &= (lower[rows] <= upper[rows, None]) & (half[near[rows]] <= upper[rows, None])
    r, c = np.nonzero(open_)
    d2 = ((x[r] - entries[c]) ** 2).sum(1)
    lower[r, c] = down(np.sqrt(d2))
    # of each row the least distance, then the lowest number; its own entry takes part
    who, number, size = np.r_[rows, r], np.r_[near[rows], c], np.r_[own, d2]
    order = np.lexsort((number, size, who))
    first = order[np.flatnonzero(np.r_[True, who[order][1:] != who[order][:-1]])] if len(order) else order
    near[who[first]], upper[who[first]] = number[first], up(np.sqrt(size[first]))
    return near.astype(np.uint8), upper, lower, done + len(r)


class Block:
    """Some vectors of one width with their bounds."""

    def __init__(self, width: int, ids: bytes, labels: bytes, unlabelled: bytes, vectors: np.ndarray, near=None, upper=None, lower=None):
        self.width, self.ids, self.labels, self.unlabelled, self.vectors = width, ids, labels, unlabelled, vectors
        self.near, self.upper, self.lower = near, upper, lower

    @classmethod
    def of(cls, row: dict) -> Block:
        n, width = row["size"], row["width"]
        vectors = np.frombuffer(row["vectors"], "<i8").reshape(n, width)
        if not row["near"]:
            return cls(width, row["ids"], row["labels"], row["unlabelled"], vectors)
        near, upper = np.frombuffer(row["near"], np.uint8).reshape(PARTS, n), np.frombuffer(row["upper"], np.float32).reshape(PARTS, n)
        return cls(width, row["ids"], row["labels"], row["unlabelled"], vectors, near, upper, np.frombuffer(row["lower"], np.float16).reshape(PARTS, n, -1))

    def bounds(self) -> list[tuple[int, int]]:
        ends = part_ends(self.width)
        return list(zip(ends, ends[1:], strict=False))

    def parts(self) -> Iterator[np.ndarray]:
        for a, b in self.bounds():
            yield self.vectors[:, a:b]

    def assign(self, books: list[np.ndarray], before: list[np.ndarray] | None) -> int:
        """Assigns all parts to ``books``, whose entries were at ``before`` when the bounds held; number of distances computed."""
        found, computed = [], 0
        for k, (x, entries) in enumerate(zip(self.parts(), books, strict=True)):
            if before is None:
                found.append(assigned(x, entries))
                computed += x.shape[0] * len(entries)
                continue
            way = np.sqrt(((entries - before[k]) ** 2).sum(1))
            upper, lower = moved(self.near[k], self.upper[k], self.lower[k], way)
            *bounds, n = reassigned(x, entries, self.near[k], upper, lower)
            found.append(bounds)
            computed += n
        self.near, self.upper, self.lower = (np.stack(x) for x in zip(*found, strict=True))
        return computed

    def sums(self, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sums of the parts of each entry, laid out as the vectors are; numbers of parts of each entry and part)."""
        total, counts = np.zeros((len(books[0]), self.width), np.int64), []
        for near, (a, b) in zip(self.near, self.bounds(), strict=True):
            np.add.at(total[:, a:b], near, self.vectors[:, a:b])
            counts.append(np.bincount(near, minlength=len(books[0])))
        return total, np.stack(counts, 1)

    def row(self) -> dict:
        return {
            "width": self.width, "size": len(self.vectors), "ids": self.ids, "labels": self.labels, "unlabelled": self.unlabelled, "vectors": self.vectors.tobytes(),
            "near": self.near.tobytes(), "upper": self.upper.tobytes(), "lower": kept(self.lower).tobytes(),
        }


def _table(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
    names = [c.strip().split()[0] for c in _STATE.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=True)], names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: (id, label, v) -> blocks of vectors of one width, without bounds yet."""
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            width = np.array([len(v) for v in batch.column(2)])
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                some = batch.take(pa.array(at))
                v = some.column(2).flatten().to_numpy().reshape(len(at), w).astype("<i8")
                longest = max(1, -(-w // PARTS))
                if v.size and longest * (2 * int(np.abs(v).max())) ** 2 >= 1 << 62:
                    raise ValueError("components are too large for 64-bit squared distances")
                none = some.column(1).is_null().to_numpy(zero_copy_only=False)
                ids, labels = some.column(0).to_numpy(), some.column(1).fill_null(0).to_numpy()
                empty = {c: b"" for c in ("near", "upper", "lower")}
                yield _table([{"width": w, "size": len(at), "ids": ids.tobytes(), "labels": labels.tobytes(), "unlabelled": none.tobytes(), "vectors": v.tobytes(), **empty}])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block.of(batch.slice(k, 1).to_pylist()[0])


def _round(books: Books, before: Books | None):
    """Task function: blocks -> blocks assigned to ``books``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read(batches):
            block.assign(books[block.width], before and before[block.width])
            yield _table([block.row()])

    return step


def _summed(books: Books):
    """Task function: assigned blocks -> (width, part, entry, position, total, n) over the task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for block in _read(batches):
            new = block.sums(books[block.width])
            held = found.setdefault(block.width, [np.zeros_like(x) for x in new])
            for x, y in zip(held, new, strict=True):
                x += y
        for width, (total, counts) in found.items():
            ends = part_ends(width)
            part = np.repeat(np.arange(PARTS), np.diff(ends))
            entry, at = np.nonzero(counts[:, part])
            columns = [np.full(len(at), width), part[at], entry, at - np.array(ends)[part[at]], total[entry, at], counts[entry, part[at]]]
            kinds = [*[pa.int32()] * 4, *[pa.int64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["width", "part", "entry", "position", "total", "n"])

    return summed


def _coded(books: Books, before: Books | None, digests: dict[int, str]):
    """Task function: blocks -> (id, label, code, error, codebooks_sha256) after the last assignment."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read(batches):
            own = books[block.width]
            block.assign(own, before and before[block.width])
            error = sum(((x - entries[near]) ** 2).sum(1) for x, entries, near in zip(block.parts(), own, block.near, strict=True))
            digits = [row.tobytes().hex() for row in np.ascontiguousarray(block.near.T)]
            labels = pa.array(np.frombuffer(block.labels, np.int64), mask=np.frombuffer(block.unlabelled, bool))
            columns = [pa.array(np.frombuffer(block.ids, np.int64)), labels, pa.array(digits, pa.string()), pa.array(np.asarray(error, np.int64)), pa.array([digests[block.width]] * len(digits), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error", "codebooks_sha256"])

    return coded


def first_books(vectors: DataFrame, widths: Sequence[int], entries: int = ENTRIES) -> Books:
    """Codebooks whose entries are the parts of the vectors with the smallest ids of each width."""
    place = F.row_number().over(Window.partitionBy("width").orderBy("id", "v"))
    rows = vectors.where(F.col("width").isin(list(widths))).withColumn("place", place).where(F.col("place") <= entries).orderBy("width", "place").collect()
    books = {}
    for w in widths:
        of = [r.v for r in rows if r.width == w]
        v = np.array(of, np.int64).reshape(len(of), w)
        ends = part_ends(w)
        books[w] = [v[:, a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return books


def updated(books: Books, sums: Sequence) -> Books:
    """Entries replaced by the floors of their parts' means; unused ones stay."""
    new = {w: [x.copy() for x in parts] for w, parts in books.items()}
    for r in sums:
        new[r.width][r.part][r.entry, r.position] = r.total // r.n  # Python's division rounds down
    return new


def digest(parts: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for part in parts for x in part.ravel().tolist()).encode()).hexdigest()


def _groups(widths: list[int], entries: int) -> Iterator[list[int]]:
    """Widths whose codebooks together stay below BOOKS_BYTES, or one alone."""
    some, held = [], 0
    for w in widths:
        if some and held + 8 * entries * w > BOOKS_BYTES:
            yield some
            some, held = [], 0
        some.append(w)
        held += 8 * entries * w
    if some:
        yield some


def with_label_sums(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the sum of error over rows of its label; nulls are one label.

    Labels that hold a 64th of the rows or more, of which there are at most 64, are joined by broadcast; the others by
    their label, so that no task gets the rows of a hot one.
    """
    sums = stash(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "labels")
    most = sums.agg(F.sum("rows")).first()[0] or 0
    marked = sums.withColumn("hot", (F.col("rows") >= most * HOT) | F.col("label").isNull())
    hot = F.broadcast(marked.where("hot").select(F.col("label").alias("__label"), "label_error"))  # at most 64 rows and that of nulls
    sure = coded.join(hot, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")
    names = [*coded.columns, "label_error"]
    rest = sure.where("label_error is null").drop("label_error").join(marked.where("not hot").select("label", "label_error"), "label")
    return sure.where("label_error is not null").select(names).unionByName(rest.select(names))


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each row of ``vectors``.

    Components become floor(256 x); rows without id, and null vectors or ones with null or non-finite components, are left out. Vectors
    are cut into 16 consecutive parts, equal ones where the width allows it (else the first ones are longer by one; of widths
    below 16 the last ones are empty and have code 00). Each width has codebooks of its own, which begin with the vectors of
    the 64 smallest ids (of equal ids the smaller vector), fewer if there are fewer. Repeated rows are coded alike and count each.
    Labels are whole numbers; an empty table gives no rows; columns of other names are not read.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("a code digit is one byte")
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * 256))
    known = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"), F.size(vector_col).alias("width"))
    kind = "id long, label long, code string, error long, codebooks_sha256 string"
    out = spark.createDataFrame([], kind)
    widths = sorted(r.width for r in known.groupBy("width").count().collect())
    for some in _groups(widths, entries):
        books, before = first_books(known, some, entries), None
        state = known.where(F.col("width").isin(some)).select("id", "label", "v").mapInArrow(_blocks, _STATE)
        held = None
        for _ in range(rounds):
            new = stash(state.mapInArrow(_round(books, before), _STATE), "bounds")
            discard(held)
            state = held = new
            sums = held.mapInArrow(_summed(books), "width int, part int, entry int, position int, total long, n long")
            totals = sums.groupBy("width", "part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # as many as codebooks have components
            before, books = books, updated(books, totals)
        out = out.unionByName(state.mapInArrow(_coded(books, before, {w: digest(b) for w, b in books.items()}), kind))
    found = with_label_sums(stash(out, "codes"))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
