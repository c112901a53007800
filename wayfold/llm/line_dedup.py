"""Lines that many documents hold, found through sharded minimal perfect hashes rather than a join of lines.

Documents are dealt into blocks by their ids. A block sends its distinct line hashes, each once with the number of its
documents and the largest id, to the shards that the hashes belong to, one packed row a block and shard. A shard builds a
minimal perfect hash over its distinct hashes, which indexes three flat arrays: a fingerprint, the number of documents
and the largest id. Then the blocks' hashes probe those arrays, and what is too frequent goes back to the block as one
packed row. A line of a third of all documents is one entry a block, so it is no heavier for its shard than any other.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys below ``LEAST_CHARS`` code points
are left alone. Keys are compared by 128-bit hashes, of which the arrays keep 32 bits.

Rows that share an id are one document: they count once and keep their lines together. Rows without id lose nothing and
do not count. Null and empty texts are one empty line. Texts of any length are read whole, one at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.llm.common import small_batches, texts_of

LEAST_CHARS, LEAST_DOCS = 40, 5
BLANK = " \t\n\x0b\x0c\r"
#: Text of a block, at least and at most; between them it grows with the root of the input, so that rows keep some entries.
BLOCK_BYTES, MOST_BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 256 << 20, 12
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
#: What a block sends with a hash and what it gets back.
SENT = np.dtype([("a", "<u8"), ("b", "<u8"), ("last", "<i8"), ("n", "<u4")])
BACK = np.dtype([("a", "<u8"), ("b", "<u8"), ("last", "<i8")])
#: Bits of a level of the perfect hash for each key that is left.
SPREAD = 1.6
_INDEX = "shard int, size long, levels array<binary>, fingerprints binary, counts binary, lasts binary"


def line_keys(text: str, least_chars: int = LEAST_CHARS) -> Iterator[tuple[str, bytes | None]]:
    """(line, digest of its key) of each line; None for keys that are too short."""
    for line in text.split("\n"):
        key = line.strip(BLANK)
        yield line, xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= least_chars else None


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 bits of each key that differ from level to level (a multiply-and-shift finaliser over both halves)."""
    with np.errstate(over="ignore"):
        x = keys["a"] ^ (keys["b"] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by levels of bits: a key takes the place where it stands alone, others go one level down.

    A key's number is the count of taken places before its own, over all levels, so n keys have the numbers 0 to n - 1.
    Foreign keys get some number, or -1; fingerprints tell them apart.
    """

    def __init__(self, levels: list[np.ndarray]):
        """``levels``: places of each level, one byte each."""
        self.levels = levels
        before, self.ranks = 0, []
        for taken in levels:
            self.ranks.append(before + np.cumsum(taken, dtype=np.int64) - taken)
            before += int(taken.sum())
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct ``keys``."""
        levels = []
        while len(keys):
            room = max(8, math.ceil(len(keys) * SPREAD))
            at = (mixed(keys, len(levels)) % np.uint64(room)).astype(np.int64)
            alone = np.bincount(at, minlength=room) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[at]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (taken, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = (mixed(keys[left], k) % np.uint64(len(taken))).astype(np.int64)
            here = taken[at] == 1
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out

    def packed(self) -> list[bytes]:
        return [len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def unpacked(cls, raw: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")) for x in raw])


class Shard:
    """Arrays over the distinct hashes of a shard, by their number: fingerprint, documents, largest id."""

    def __init__(self, index: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, lasts: np.ndarray):
        self.index, self.fingerprints, self.counts, self.lasts = index, fingerprints, counts, lasts

    @classmethod
    def build(cls, rows: list[np.ndarray]) -> Shard:
        """Of what blocks sent."""
        sent = np.concatenate(rows) if rows else np.empty(0, SENT)
        order = np.lexsort((sent["b"], sent["a"]))
        a, b = sent["a"][order], sent["b"][order]
        keys = np.empty(len(order), KEY)
        keys["a"], keys["b"] = a, b
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        keys = keys[new]
        index = PerfectHash.build(keys)
        prints = np.zeros(index.size, np.uint32)
        prints[index.number(keys)] = fingerprint(keys)
        counts, lasts = np.zeros(index.size, np.int64), np.full(index.size, np.iinfo(np.int64).min)
        for row in rows:  # hashes of one row are distinct
            at = index.number(row)
            counts[at] += row["n"]
            lasts[at] = np.maximum(lasts[at], row["last"])
        return cls(index, prints, np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32), lasts)

    def probe(self, keys: np.ndarray, least_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is in at least so many documents, the largest id that holds it)."""
        at = self.index.number(keys)
        if not self.index.size:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        known = (at >= 0) & (self.fingerprints[at] == fingerprint(keys))
        return known & (self.counts[at] >= least_docs), self.lasts[at]


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (keys["b"] >> np.uint64(32)).astype(np.uint32)


def _hashed(least_chars: int, shards: int):
    """Task function: (row, id, text, block) -> (shard, block, sent): each block's distinct hashes, one row a shard."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list[bytes], list[int], list[int]]] = {}
        for batch in batches:
            for block, i, text in zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), texts_of(batch.column("text")), strict=True):
                digests, owners, sizes = found.setdefault(block, ([], [], []))
                some = {d for _, d in line_keys(text or "", least_chars) if d}
                if some and i is not None:
                    digests.append(b"".join(some))
                    owners.append(i)
                    sizes.append(len(some))
        for block in list(found):
            rows = counted(*found.pop(block))
            if not len(rows):
                continue
            which = (rows["a"] % np.uint64(shards)).astype(np.int32)
            order = np.argsort(which, kind="stable")
            rows, which = rows[order], which[order]
            starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            sent = [rows[s:e].tobytes() for s, e in zip(starts, [*starts[1:], len(rows)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(which[starts]), pa.array(np.full(len(sent), block, np.int32)), pa.array(sent, pa.binary())], ["shard", "block", "sent"])

    return hashed


def counted(digests: list[bytes], owners: list[int], sizes: list[int]) -> np.ndarray:
    """Distinct hashes of some documents with the number of their ids and the largest one."""
    keys = np.frombuffer(b"".join(digests), KEY)
    ids = np.repeat(np.array(owners, np.int64), sizes)
    order = np.lexsort((ids, keys["b"], keys["a"]))
    a, b, ids = keys["a"][order], keys["b"][order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    other = new.copy()
    other[1:] |= ids[1:] != ids[:-1]  # rows that share an id count once
    starts = np.flatnonzero(new)
    out = np.empty(len(starts), SENT)
    if len(starts):
        out["a"], out["b"] = a[starts], b[starts]
        out["n"] = np.add.reduceat(other.astype(np.int64), starts)
        out["last"] = ids[np.r_[starts[1:], len(ids)] - 1]
    return out


def _read(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), SENT) for x in column]


def _answered(least_docs: int):
    """Group function of a shard: builds its arrays, lets the blocks' hashes probe them; (block, back) for each block that loses lines."""

    def answered(group: pa.Table) -> pa.Table:
        rows = _read(group.column("sent"))
        shard = Shard.build(rows)
        blocks, back = [], []
        for block, row in zip(group.column("block").to_pylist(), rows, strict=True):
            often, lasts = shard.probe(row, least_docs)
            if often.any():
                out = np.empty(int(often.sum()), BACK)
                out["a"], out["b"], out["last"] = row["a"][often], row["b"][often], lasts[often]
                blocks.append(block)
                back.append(out.tobytes())
        return pa.table({"block": pa.array(blocks, pa.int32()), "back": pa.array(back, pa.binary())})

    return answered


def _indexed(group: pa.Table) -> pa.Table:
    """Group function of a shard: its arrays as a row."""
    shard = Shard.build(_read(group.column("sent")))
    arrays = [shard.fingerprints, shard.counts, shard.lasts]
    columns = [group.column("shard")[:1], pa.array([shard.index.size]), pa.array([shard.index.packed()], pa.list_(pa.binary())), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]]
    return pa.table(columns, ["shard", "size", "levels", "fingerprints", "counts", "lasts"])


def kept_lines(text: str, i: int | None, often: dict[bytes, int], least_chars: int = LEAST_CHARS) -> tuple[list[str], int]:
    """(lines that stay, number of all lines) of document ``i`` (null: nothing goes); ``often`` has the largest id of the digests that are too frequent."""
    kept, n = [], 0
    for line, digest in line_keys(text, least_chars):
        n += 1
        last = often.get(digest) if digest and i is not None else None
        if last is None or last == i:
            kept.append(line)
    return kept, n


def _finished(finish, least_chars: int, names: list[str]):
    """Group function of a block: its documents and what went back to it -> (row, what ``finish`` gives)."""

    def finished(docs: pa.Table, back: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_py(), BACK) for x in back.column("back")]) if back.num_rows else np.empty(0, BACK)
        keys = np.ascontiguousarray(np.stack([rows["a"], rows["b"]], 1)).astype("<u8").tobytes()
        often = {keys[16 * k : 16 * k + 16]: last for k, last in enumerate(rows["last"].tolist())}
        ids, texts = docs.column("id").to_pylist(), docs.column("text")
        found = finish(texts, (kept_lines(t.as_py() or "", i, often, least_chars) for i, t in zip(ids, texts, strict=True)))
        return pa.table([docs.column("row"), *found], ["row", *names])

    return finished


def _sizes(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(blocks, shards) for the texts of ``docs``: a shard takes in as many hashes as some blocks send out."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    block = min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, math.isqrt(800 * size)))
    blocks = max(LEAST_BLOCKS, math.ceil(size / block))
    return blocks, blocks


def _sent(dealt: DataFrame, shards: int, least_chars: int) -> DataFrame:
    # no column is taken away and no row, so that the exchange below is that of the last step
    return dealt.mapInArrow(_hashed(least_chars, shards), "shard int, block int, sent binary")


def _dealt(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """(row, id, text, block), by block; rows without id go anywhere."""
    row, i = F.struct(*[c for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).cast("long")
    keyed = small_batches(docs).select(row, i.alias("id"), F.col(text_col).alias("text"))
    # rows without id have no block of their own; what else they hold deals them out
    spread = F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("row", "text"))
    return keyed.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")).repartition(blocks, "block")


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(shard, size, levels, fingerprints, counts, lasts): the arrays of all shards, as a table to be kept.

    The shard of a key is the first half of its digest modulo the number of shards, which is that of ``_sizes``. Shards
    that hold no key have no row.
    """
    blocks, shards = _sizes(docs, text_col)
    sent = _sent(_dealt(docs, id_col, text_col, blocks), shards, least_chars)
    return sent.repartition(shards, "shard").groupBy("shard").applyInArrow(_indexed, _INDEX)


def loaded(row) -> Shard:
    """A row of :func:`line_index` as arrays that can be probed."""
    return Shard(PerfectHash.unpacked([bytes(x) for x in row["levels"]]), *(np.frombuffer(row[c], t) for c, t in (("fingerprints", np.uint32), ("counts", np.uint32), ("lasts", np.int64))))


def _joined(docs: DataFrame, id_col: str, text_col: str, least_docs: int, least_chars: int, finish, schema: StructType) -> DataFrame:
    """(row, columns of ``schema``) for each row of ``docs``."""
    blocks, shards = _sizes(docs, text_col)
    dealt = _dealt(docs, id_col, text_col, blocks)  # one exchange of the texts serves both uses
    sent = _sent(dealt, shards, least_chars).repartition(shards, "shard")
    back = sent.groupBy("shard").applyInArrow(_answered(least_docs), "block int, back binary")
    out = StructType([dealt.schema["row"], *schema.fields])
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_finished(finish, least_chars, schema.names), out)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) for every row of ``docs``.

    Keys found in at least ``least_docs`` documents lose all their lines but in the largest id that holds them; a document
    that repeats its own lines keeps or loses them together. The cases are those of the module; an empty table gives no
    rows, columns of other names are not read.
    """

    def finish(_, found) -> list[pa.Array]:
        lines, dropped, sha = [], [], []
        for kept, n in found:
            lines.append(n)
            dropped.append(n - len(kept))
            sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
        return [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]

    schema = StructType().add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    found = _joined(docs.select(id_col, text_col), id_col, text_col, least_docs, least_chars, finish, schema)
    return found.select(F.col("row").getField(id_col).alias(id_col), *schema.names)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` without the lines that :func:`digests` drops; all columns stay, null texts stay null."""

    def finish(texts, found) -> list[pa.Array]:
        return [pa.array([None if not t.is_valid else "\n".join(kept) for t, (kept, _) in zip(texts, found, strict=True)], pa.string())]

    found = _joined(docs, id_col, text_col, least_docs, least_chars, finish, StructType().add("left", "string"))
    return found.select(*((F.col("left") if k == text_col else F.col("row").getField(k)).alias(k) for k in docs.columns))
