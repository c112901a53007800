"""Exact substring dedup over a sparse suffix array.

A byte goes if a WINDOW-byte string that covers it also starts in a document with a smaller id. Sorting every suffix
would move several times the input, so only anchors are sorted: in each window the leftmost KEY-byte string with the
smallest hash. Equal windows have their anchor at the same place, so windows are equal only if their anchors'
suffixes, as far as the windows go, and what stands before them are. A stretch is a run of windows with one anchor.

First, keys that one document alone has are put aside by their hashes, which may only keep too many. The stretches of
the others then go as bytes: sampled splitters range-partition them by their suffixes, each bucket sorts them word by
word, as a multikey quicksort does, and equal windows of neighbours are found for every place that the anchor can
have in them. Keys of splitters, which lie on both sides of a boundary, and so every key of many suffixes, are
compared across buckets window by window. What is found equal is equal in its bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from wayfold.llm.common import frugal, give_back, planes, slices, small_batches, texts_of, unplanes

WINDOW, KEY = 50, 20
#: Bytes that a stretch can have before its anchor.
LEFT = WINDOW - KEY
#: Texts are scanned this many bytes at a time; so many anchors, and so many stretches, are sorted and sent on together.
FLAT = 1 << 20
_PIECE = 1 << 18
ANCHORS, SENT = 700_000, 100_000
#: Bytes of text whose stretches share a bucket; keys, which are smaller but name their documents in each bucket, share one of so many.
BUCKET_BYTES, LEAST_BUCKETS, KEYS_SHARE = 6 << 20, 64, 2
#: Splitters are taken from a sample with so many stretches a bucket, one in THINNED of those of at least so many bytes of text.
SAMPLED_ROWS, THINNED, SAMPLED_BYTES = 32, 64, 16 << 20
#: Rows of bytes that are compared at once; a bucket that holds more is taken range by range.
PART = 1 << 17
#: A stretch as a row: its suffix, what stands before the anchor from right to left, both padded, and the two lengths.
RIGHT_WIDTH, LEFT_WIDTH, ROW = 56, 32, 96
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_POWERS: list[np.ndarray] = []
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _powers() -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse: a hash of any stretch comes from one running sum."""
    if not _POWERS:
        base = 0x5851F42D4C957F2D
        for x in (base, pow(base, -1, 1 << 64)):
            out = np.ones(FLAT + WINDOW, np.uint64)
            filled, step = 1, x
            while filled < len(out):
                more = min(filled, len(out) - filled)
                out[filled : filled + more] = out[:more] * np.uint64(step)
                filled, step = filled + more, step * step % (1 << 64)
            _POWERS.append(out)
    return _POWERS


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _SPREAD[0]
    h = (h ^ (h >> np.uint64(29))) * _SPREAD[1]
    return h ^ (h >> np.uint64(32))


@dataclass
class Stretches:
    """Runs of windows with a common anchor. Places count within the flat text, ``shift`` leads to the document."""

    doc: np.ndarray
    order: np.ndarray  # of the stretch in its document
    first: np.ndarray  # first window
    anchor: np.ndarray
    last: np.ndarray  # last window
    shift: np.ndarray
    piece: np.ndarray  # of a long text
    text: np.ndarray
    sums: np.ndarray

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each stretch of the flat text."""
        return _mix((self.sums[end] - self.sums[start]) * _powers()[1][start])

    def keys(self) -> np.ndarray:
        """Stand for the anchors' first KEY bytes; unlike keys that share one only have more to compare.

        An anchor is where this hash is smallest, so it is mixed again: else most keys would fall to the first buckets.
        48 bits of it are enough to put nearly all lone keys aside, and the others compress to nothing.
        """
        return _mix(self.hashed(self.anchor, self.anchor + KEY)) & ~np.uint64(0xFFFF)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """(stretches, ROW) bytes, equal only for equal stretches; as bytes they sort by suffix, then by what stands before."""
        out = np.zeros((len(at), ROW), np.uint8)
        anchor, end = self.anchor[at], self.last[at] + WINDOW
        right, left = end - anchor, anchor - self.first[at]
        top = len(self.text) - 1
        for k in range(WINDOW):
            out[:, k] = np.where(k < right, self.text[np.minimum(anchor + k, top)], 0)
        for k in range(LEFT):
            out[:, RIGHT_WIDTH + k] = np.where(k < left, self.text[np.maximum(anchor - 1 - k, 0)], 0)
        out[:, -2], out[:, -1] = right, left
        return out

    def leaders(self) -> np.ndarray:
        """For each stretch the first equal one in the same piece of its document, itself included: repeats share its fate."""
        n = len(self.doc)
        key = _mix(self.hashed(self.first, self.last + WINDOW) + (self.anchor - self.first).astype(np.uint64) * _SPREAD[0] + self.piece.astype(np.uint64) * _SPREAD[1])
        order = np.argsort(key, kind="stable")
        start = _groups(n, key[order])
        lead = np.empty(n, np.int64)
        lead[order] = np.repeat(order[start], np.diff(np.append(start, n)))
        again = np.flatnonzero(lead != np.arange(n))
        for i in range(0, len(again), SENT):
            part = again[i : i + SENT]
            same = (self.rows(part) == self.rows(lead[part])).all(1) & (self.piece[part] == self.piece[lead[part]])
            lead[part[~same]] = part[~same]
        return lead

    def __len__(self):
        return len(self.doc)


def stretches(texts: list[bytes]) -> Iterator[Stretches]:
    """Stretches of all windows of the texts, in order; a window lies in one text. Long texts go piece by piece."""
    counts = np.zeros(len(texts), np.int64)
    pieces, size = [], 0
    for i, t in enumerate(texts):
        for base in range(0, max(0, len(t) - WINDOW + 1), _PIECE):
            part = t[base : base + _PIECE + WINDOW - 1]
            if size + len(part) > FLAT:
                yield _flat(pieces, counts)
                pieces, size = [], 0
            pieces.append((i, base, part))
            size += len(part)
    if pieces:
        yield _flat(pieces, counts)


def _flat(pieces: list[tuple[int, int, bytes]], counts: np.ndarray) -> Stretches:
    text = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    up, down = _powers()
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * up[: len(text)], out=sums[1:])
    n = len(text) - KEY + 1
    low = _mix((sums[KEY:] - sums[:n]) * down[:n])
    mask = np.uint64(FLAT - 1)
    low = (low & ~mask) | np.arange(n, dtype=np.uint64)
    span = WINDOW - KEY + 1  # keys in a window: 31
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: len(text) - WINDOW + 1], low[span - 16 :])
    anchor = (low & mask).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in pieces])
    begins = np.cumsum(sizes) - sizes
    keep = np.ones(len(anchor), bool)
    for e in np.cumsum(sizes)[:-1]:
        keep[e - WINDOW + 1 : e] = False
    at = np.flatnonzero(keep)
    anchor = anchor[at]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
    start = np.flatnonzero(new)
    first, last = at[start], at[np.append(start[1:], len(at)) - 1]
    piece = np.searchsorted(begins, first, "right") - 1
    doc = np.array([i for i, _, _ in pieces])[piece]
    shift = np.array([b for _, b, _ in pieces])[piece] - begins[piece]
    of_doc = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(of_doc, len(doc)))
    order = np.arange(len(doc)) - np.repeat(of_doc, size) + counts[doc]
    np.add.at(counts, doc[of_doc], size)
    return Stretches(doc, order, first, anchor[start], last, shift, piece, text, sums)


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, ties by the second, and so on; each further key sorts only what is tied so far."""
    order = np.argsort(keys[0], kind="stable")
    for depth in range(1, len(keys)):
        tied = np.zeros(len(order), bool)
        same = np.ones(max(0, len(order) - 1), bool)
        for k in keys[:depth]:
            k = k[order]
            same &= k[1:] == k[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(np.append(True, ~same))[at]
        order[at] = order[at][np.lexsort((keys[depth][order[at]], group))]
    return order


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, eight at a time, and where groups of equal rows start in it."""
    words = np.ascontiguousarray(rows.reshape(len(rows), rows.shape[1] // 8, 8).view(">u8")[:, :, 0].T.astype(np.uint64))
    order = multikey_order(*words)
    return order, _groups(len(rows), *(w[order] for w in words))


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(planes(np.ascontiguousarray(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(arrays[0]).to_bytes(8, "little") + raw)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(unplanes(raw[at : at + size], k))
        at += size
    return out


_NAMES = ["bucket", "kind", "id", "tid", "data"]
_SENT = "bucket int, kind tinyint, id long, tid long, data binary"
_BACK = "kind tinyint, id long, tid long, data binary"
#: Kinds of row: packed entries; stretches that go whole; stretches that hand on their bytes; windows that go; packed stretches; packed windows.
ENTRIES, GONE, OPEN, WINDOWS, STRETCHES, SINGLE = range(6)


def _by_doc(kind: int, doc: np.ndarray, number: np.ndarray, ids: np.ndarray, tids: np.ndarray) -> list[pa.Array]:
    """Columns (kind, id, tid, data): for each document its numbers, four bytes each."""
    order = np.lexsort((number, doc))
    doc, number = doc[order], number[order]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    ends = (np.append(first, len(doc)) * 4).astype(np.int32)
    data = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(number.astype("<u4").tobytes())])
    return [pa.array(np.full(len(first), kind, np.int8)), pa.array(ids[doc[first]]), pa.array(tids[doc[first]]), data]


def _sent(bucket: int | np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int32(bucket), len(columns[0]))), *columns], _NAMES)


def _entries(cut: np.ndarray, arrays: list[np.ndarray], doc: np.ndarray, ids: np.ndarray, tids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row of packed entries for each bucket; ``cut`` has where the buckets begin and end."""
    for b in np.flatnonzero(np.diff(cut)):
        part = slice(cut[b], cut[b + 1])
        who, at = np.unique(doc[part], return_inverse=True)
        table = _pack(ids[who], tids[who])
        data = len(table).to_bytes(4, "little") + table + _pack(at.astype(np.uint32), *(a[part] for a in arrays))
        yield _sent(b, [pa.array([ENTRIES], pa.int8()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([data], pa.binary())])


def _gathered(table: pa.Table, *kinds) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a bucket: their arrays, the document of each, and the documents' ids, ascending, with tids."""
    arrays, ids, tids = [[] for _ in kinds], [], []
    for data in table.column("data").to_pylist():
        at = 4 + int.from_bytes(data[:4], "little")
        i, t = _unpack(data[4:at], np.int64, np.int64)
        who, *found = _unpack(data[at:], np.uint32, *kinds)
        for a, f in zip(arrays, found, strict=True):
            a.append(f)
        ids.append(i[who])
        tids.append(t[who])
    return [np.concatenate(a) for a in arrays], *_documents(np.concatenate(ids), np.concatenate(tids))


def _documents(ids: np.ndarray, tids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document of each entry as a number, and the documents' ids, ascending, with tids."""
    order = np.lexsort((tids, ids))
    new = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(tids[order]) != 0))[: len(ids)]
    doc = np.empty(len(ids), np.int64)
    doc[order] = np.cumsum(new) - 1
    return doc, ids[order][new], tids[order][new]


def _groups(n: int, *sorted_keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys start."""
    new = np.zeros(max(0, n - 1), bool)
    for k in sorted_keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.append(True, new))


def _homes(columns: list[pa.Array], buckets: int) -> np.ndarray:
    """Any bucket for rows that need none."""
    return (columns[2].to_numpy().view(np.uint64) % np.uint64(buckets)).astype(np.int32)


def _anchors(buckets: int):
    """Task function: (id, tid, text) -> keys by bucket; anchors whose key two documents have here are open at once."""

    def send(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, number, own, tid = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, number, own, tid = (a[order] for a in (key, number, own, tid))
        start = _groups(len(key), key)
        size = np.diff(np.append(start, len(key)))
        several = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
        doc, ids, tids = _documents(own, tid)
        known = np.repeat(several, size)
        if known.any():
            columns = _by_doc(OPEN, doc[known], number[known], ids, tids)
            yield _sent(_homes(columns, buckets), columns)
        stay = ~known
        stay[start[several]] = True  # one stands for all of them
        key, number, doc, known = key[stay], number[stay], doc[stay], known[stay]
        cut = np.searchsorted(key >> np.uint64(32), (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets))
        yield from _entries(cut, [key, number, known.astype(np.uint8)], doc, ids, tids)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in slices(batches, column=2):
            ids, tids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in stretches([t.encode() for t in texts_of(batch.column(2))]):
                at = np.flatnonzero(s.leaders() == np.arange(len(s)))
                parts.append((s.keys()[at], s.order[at].astype(np.uint32), ids[s.doc[at]], tids[s.doc[at]]))
                size += len(at)
                if size >= ANCHORS:
                    yield from send(parts)
                    parts, size = [], 0
        if parts:
            yield from send(parts)

    return anchors


def _passed_on(table: pa.Table, kinds: tuple[int, ...]) -> list[pa.Table]:
    kind = table.column("kind").to_numpy()
    return [table.filter(pa.array(np.isin(kind, kinds))).select(_NAMES[1:])]


def _shared(table: pa.Table) -> pa.Table:
    """One bucket of keys: those of two documents or more are open."""
    out = _passed_on(table, (OPEN,))
    entries = table.filter(pa.array(table.column("kind").to_numpy() == ENTRIES))
    if len(entries):
        (key, number, known), doc, ids, tids = _gathered(entries, np.uint64, np.uint32, np.uint8)
        order = np.argsort(key, kind="stable")
        key, number, known, doc = (a[order] for a in (key, number, known, doc))
        start = _groups(len(key), key)
        own = ids[doc]
        several = (np.maximum.reduceat(known, start) > 0) | (np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start))
        chosen = np.repeat(several, np.diff(np.append(start, len(key)))) & (known == 0)
        out.append(pa.Table.from_arrays(_by_doc(OPEN, doc[chosen], number[chosen], ids, tids), _NAMES[1:]))
    give_back()
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def _single(rows: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(which rows have it, its place in the stretch from the anchor back, the bytes) of the windows of stretches, by place."""
    right, left = rows[:, -2], rows[:, -1]
    for p in range(LEFT + 1):
        at = np.flatnonzero((left >= p) & (right >= WINDOW - p))
        if len(at):
            window = np.zeros((len(at), RIGHT_WIDTH), np.uint8)
            window[:, :p] = rows[at, RIGHT_WIDTH : RIGHT_WIDTH + p][:, ::-1]
            window[:, p:WINDOW] = rows[at, : WINDOW - p]
            yield at, p, window


def _packed_bytes(kind: int, bucket: int, rows: np.ndarray, arrays: list[np.ndarray], doc: np.ndarray, ids: np.ndarray, tids: np.ndarray) -> pa.RecordBatch:
    who, at = np.unique(doc, return_inverse=True)
    parts = _pack(ids[who], tids[who]), _pack(at.astype(np.uint32), *arrays), zstandard.ZstdCompressor(level=3).compress(rows.tobytes())
    data = b"".join(len(x).to_bytes(4, "little") + x for x in parts)
    return _sent(bucket, [pa.array([kind], pa.int8()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([data], pa.binary())])


def _raws(data: bytes) -> list[bytes]:
    """The three parts that :func:`_packed_bytes` joined."""
    out, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : end])
        at = end
    return out


def _parts(table: pa.Table, width: int, key: int, *kinds) -> Iterator[list[list[bytes]]]:
    """The blocks of a table in ranges of the first ``key`` bytes, of about PART rows each, but for one key with more.

    Every block is in order, so it is cut by binary search; of a large bucket only one range is unpacked at a time.
    """
    blocks = [_raws(x.as_py()) for x in table.column("data")]
    total = sum(zstandard.get_frame_parameters(b[2]).content_size for b in blocks) // width
    if total <= PART:
        if blocks:
            yield blocks
        return
    opened = lambda b: np.frombuffer(zstandard.ZstdDecompressor().decompress(b[2]), np.uint8).reshape(-1, width)
    keys = lambda rows: np.ascontiguousarray(rows[:, :key]).view(f"S{key}").ravel()
    step, seen, drawn = max(1, PART // 64), 0, []
    for b in blocks:
        rows = opened(b)
        drawn.append(keys(rows[-seen % step :: step]))
        seen += len(rows)
    drawn = np.sort(np.concatenate(drawn))
    edges = np.unique(drawn[np.linspace(0, len(drawn), -(-total // PART) + 1).astype(np.int64)[1:-1]])
    out: list[list[list[bytes]]] = [[] for _ in range(len(edges) + 1)]
    while blocks:
        b = blocks.pop()
        rows, arrays = opened(b), _unpack(b[1], np.uint32, *kinds)
        cut = np.concatenate([[0], np.searchsorted(keys(rows), edges, "left"), [len(rows)]])
        for r in np.flatnonzero(np.diff(cut)):
            some = slice(cut[r], cut[r + 1])
            out[r].append([b[0], _pack(*(x[some] for x in arrays)), zstandard.ZstdCompressor(level=1).compress(rows[some].tobytes())])
    yield from filter(None, out)


def _unpacked_bytes(blocks: list[list[bytes]], width: int, *kinds) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """All rows of bytes of blocks with their arrays, the document of each, and the documents' ids, ascending, with tids."""
    rows, arrays, ids, tids = [], [[] for _ in kinds], [], []
    for raws in blocks:
        i, t = _unpack(raws[0], np.int64, np.int64)
        who, *found = _unpack(raws[1], np.uint32, *kinds)
        for a, f in zip(arrays, found, strict=True):
            a.append(f)
        ids.append(i[who])
        tids.append(t[who])
        rows.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(raws[2]), np.uint8).reshape(-1, width))
    return np.concatenate(rows), [np.concatenate(a) for a in arrays], *_documents(np.concatenate(ids), np.concatenate(tids))


def _least(own: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The smallest id of each one's group, of a sorted array whose groups start as said."""
    return np.repeat(np.minimum.reduceat(own, start), np.diff(np.append(start, len(own)))) if len(own) else own


def _suffixes(splitters: np.ndarray, buckets: int):
    """Task function: (id, tid, text, open) -> open stretches by bucket. Those found in a smaller document here go at once."""
    edges = splitters.view(f"S{ROW}").ravel()
    cut_keys = np.unique(np.ascontiguousarray(splitters[:, :KEY]).view(f"S{KEY}").ravel())

    def windows(rows: np.ndarray, place: np.ndarray, doc: np.ndarray, ids: np.ndarray, tids: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [(window, place[at] + rows[at, -1] - p, doc[at]) for at, p, window in _single(rows)]
        if not found:
            return
        window, place, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order, start = suffix_order(window)
        window, place, doc = window[order], place[order].astype(np.uint32), doc[order]
        gone = ids[doc] > _least(ids[doc], start)
        if gone.any():
            columns = _by_doc(WINDOWS, doc[gone], place[gone], ids, tids)
            yield _sent(_homes(columns, buckets), columns)
        window, place, doc = window[~gone], place[~gone], doc[~gone]
        words = window.view("<u8").astype(np.uint64)
        to = _mix((words * _BYTE[: words.shape[1]]).sum(1, dtype=np.uint64)) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        start = _groups(len(to), to[order])
        for a, b in zip(start, np.append(start[1:], len(to)), strict=True):
            at = order[a:b]
            yield _packed_bytes(SINGLE, int(to[at[0]]), window[at], [place[at]], doc[at], ids, tids)

    def send(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        rows, number, place, own, tid = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, start = suffix_order(rows)
        rows, number, place, own, tid = (a[order] for a in (rows, number, place, own, tid))
        doc, ids, tids = _documents(own, tid)
        gone = own > _least(own, start)
        if gone.any():
            columns = _by_doc(GONE, doc[gone], number[gone], ids, tids)
            yield _sent(_homes(columns, buckets), columns)
        rows, number, place, doc = rows[~gone], number[~gone], place[~gone], doc[~gone]
        key = np.ascontiguousarray(rows[:, :KEY]).view(f"S{KEY}").ravel()
        across = np.isin(key, cut_keys)
        if across.any():
            yield from windows(rows[across], place[across], doc[across], ids, tids)
            rows, number, place, doc = rows[~across], number[~across], place[~across], doc[~across]
        names = np.ascontiguousarray(rows).view(f"S{ROW}").ravel()
        cut = np.concatenate([[0], np.searchsorted(names, edges, "left"), [len(names)]])
        for b in np.flatnonzero(np.diff(cut)):
            part = slice(cut[b], cut[b + 1])
            yield _packed_bytes(STRETCHES, int(b) % buckets, rows[part], [number[part], place[part]], doc[part], ids, tids)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in slices(batches, column=2):
            ids, tids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            opened = [np.frombuffer(b"".join(x), "<u4") for x in batch.column(3).to_pylist()]
            key = np.sort(np.concatenate([np.int64(i) << np.int64(32) | x.astype(np.int64) for i, x in enumerate(opened)])) if opened else np.zeros(0, np.int64)
            for s in stretches([t.encode() for t in texts_of(batch.column(2))]):
                at = np.flatnonzero(np.isin(s.doc.astype(np.int64) << np.int64(32) | s.order, key))
                for i in range(0, len(at), SENT):
                    some = at[i : i + SENT]
                    place = (s.first[some] + s.shift[some]).astype(np.uint32)
                    parts.append((s.rows(some), s.order[some].astype(np.uint32), place, ids[s.doc[some]], tids[s.doc[some]]))
                    size += len(some)
                    if size >= SENT:
                        yield from send(parts)
                        parts, size = [], 0
        if parts:
            yield from send(parts)

    return suffixes


def _equal_windows(rows: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(which stretches, place of the window) where a window is also in a stretch of a smaller document.

    ``rows`` are in the order of their suffixes, so windows with equal bytes from the anchor on are neighbours; among those,
    equal bytes before the anchor have equal ranks.
    """
    before = np.ascontiguousarray(rows[:, RIGHT_WIDTH : RIGHT_WIDTH + LEFT_WIDTH])
    by_left, _ = suffix_order(before)
    differ = before[by_left[1:]] != before[by_left[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), LEFT_WIDTH)  # bytes before the anchor that neighbours share
    for p in range(LEFT + 1):
        at = np.flatnonzero((rows[:, -1] >= p) & (rows[:, -2] >= WINDOW - p))
        if len(at) < 2:
            continue
        suffix = rows[at, : WINDOW - p]
        run = np.cumsum(np.append(False, (suffix[1:] != suffix[:-1]).any(1)))
        many = np.bincount(run)[run] > 1
        at, run = at[many], run[many]
        if not len(at):
            continue
        rank = np.empty(len(rows), np.int64)
        rank[by_left] = np.cumsum(np.append(0, common < p))
        key = run.astype(np.int64) * len(rows) + rank[at]
        order = np.argsort(key, kind="stable")
        at = at[order]
        gone = own[at] > _least(own[at], _groups(len(at), key[order]))
        if gone.any():
            yield at[gone], p


def _compare(table: pa.Table) -> pa.Table:
    """One bucket: sort the suffixes, settle equal stretches, then compare the windows of neighbours."""
    kind = table.column("kind").to_numpy()
    out = _passed_on(table, (GONE, WINDOWS))
    add = lambda what, doc, number, ids, tids: out.append(pa.Table.from_arrays(_by_doc(what, doc, number, ids, tids), _NAMES[1:]))
    for part in _parts(table.filter(pa.array(kind == STRETCHES)), ROW, KEY, np.uint32, np.uint32):
        rows, (number, place), doc, ids, tids = _unpacked_bytes(part, ROW, np.uint32, np.uint32)
        order, start = suffix_order(rows)
        rows, number, place, doc = rows[order], number[order], place[order], doc[order]
        own = ids[doc]
        gone = own > _least(own, start)
        add(GONE, doc[gone], number[gone], ids, tids)
        rows, place, doc, own = rows[~gone], place[~gone], doc[~gone], own[~gone]
        if not len(rows):
            continue
        key = rows[:, :KEY]
        keys = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        size = np.diff(np.append(keys, len(rows)))
        several = np.repeat(np.minimum.reduceat(own, keys) != np.maximum.reduceat(own, keys), size)
        rows, place, doc, own = rows[several], place[several], doc[several], own[several]
        found = [(doc[at], place[at] + rows[at, -1] - np.uint32(p)) for at, p in _equal_windows(rows, own)]
        if found:
            add(WINDOWS, *(np.concatenate(x) for x in zip(*found, strict=True)), ids, tids)
    for part in _parts(table.filter(pa.array(kind == SINGLE)), RIGHT_WIDTH, WINDOW, np.uint32):
        window, (place,), doc, ids, tids = _unpacked_bytes(part, RIGHT_WIDTH, np.uint32)
        order, start = suffix_order(window)
        place, doc = place[order], doc[order]
        gone = ids[doc] > _least(ids[doc], start)
        add(WINDOWS, doc[gone], place[gone], ids, tids)
    give_back()
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def _spans(finish):
    """Task function: (row, text, gone, windows) -> ``finish(row, texts, removed runs)``, runs as start, end in turn."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=1):
            texts = [t.encode() if t else b"" for t in texts_of(batch.column(1))]
            gone, windows = ([np.frombuffer(b"".join(x or ()), "<u4").astype(np.int64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            starts, ends = [[w] for w in windows], [[w + WINDOW] for w in windows]
            some = [i for i, (g, w) in enumerate(zip(gone, windows, strict=True)) if len(g) or len(w)]
            key = np.sort(np.concatenate([np.int64(k) << np.int64(32) | gone[i] for k, i in enumerate(some)])) if some else None
            single = np.sort(np.concatenate([np.int64(k) << np.int64(32) | windows[i] for k, i in enumerate(some)])) if some else None
            for s in stretches([texts[i] for i in some]):
                lead, of = s.leaders(), s.doc.astype(np.int64) << np.int64(32)
                chosen = np.flatnonzero(np.isin(of | s.order, key)[lead])
                parts = [(s.doc[chosen], s.first[chosen] + s.shift[chosen], s.last[chosen] + WINDOW + s.shift[chosen])]
                again = np.flatnonzero(lead != np.arange(len(s)))
                if len(again):  # windows of a stretch go in its repeats, too
                    begin = s.first[lead[again]] + s.shift[lead[again]]
                    lo = np.searchsorted(single, of[again] | begin)
                    n = np.searchsorted(single, of[again] | begin + s.last[again] - s.first[again], "right") - lo
                    which = np.repeat(np.arange(len(again)), n)
                    found = single[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] & np.int64(0xFFFFFFFF)
                    place = found - begin[which] + (s.first + s.shift)[again[which]]
                    parts.append((s.doc[again[which]], place, place + WINDOW))
                for doc, a, b in parts:
                    order = np.argsort(doc, kind="stable")
                    for c in np.split(order, _groups(len(order), doc[order])[1:]) if len(order) else ():
                        starts[some[doc[c[0]]]].append(a[c])
                        ends[some[doc[c[0]]]].append(b[c])
            found = [_union(np.concatenate(a), np.concatenate(b)) for a, b in zip(starts, ends, strict=True)]
            yield finish(batch, texts, found)

    return spans


def _union(start: np.ndarray, end: np.ndarray) -> list[int]:
    """Maximal runs of the union of spans, as start, end, start, end ..."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    first = np.flatnonzero(new)
    return np.column_stack([start[first], end[np.append(first[1:], len(start)) - 1]]).ravel().tolist()


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text, gone, windows): ``docs``, the other columns as a struct, with what of the text goes, as ``_spans`` takes it.

    Ids are integers. Texts are taken as UTF-8 bytes; null is empty, and texts below WINDOW bytes lose nothing.
    Rows without id neither lose anything nor count as smaller. Rows with equal ids do not count against each
    other.
    """
    spark = docs.sparkSession
    text = F.col(text_col) if text_col == "text" else F.col(text_col).alias("text")  # an alias for nothing would make the exchanges differ
    keyed = small_batches(docs).select(F.struct(*[c for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tid"), text)
    known = keyed.where("id is not null")
    sized = known.where(f"octet_length(text) >= {WINDOW}").select("id", "tid", "text")
    size = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    of_keys = -(-buckets // KEYS_SHARE)
    sent = sized.mapInArrow(frugal(_anchors(of_keys)), _SENT).repartition(of_keys, "bucket")
    opened = sent.groupBy("bucket").applyInArrow(_shared, _BACK)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    # one exchange of the texts serves both joins, as both take the same columns
    dealt = known.repartition(parts, "id", "tid")
    several = dealt.join(opened.groupBy("id", "tid").agg(F.collect_list("data").alias("open")), ["id", "tid"]).select("id", "tid", "text", "open", "row")
    handed = several.mapInArrow(frugal(_suffixes(_splitters(sized, size, buckets), buckets)), _SENT).repartition(buckets, "bucket")
    back = handed.groupBy("bucket").applyInArrow(_compare, _BACK)
    some = lambda kind, name: F.collect_list(F.when(F.col("kind") == kind, F.col("data"))).alias(name)
    joined = dealt.join(back.groupBy("id", "tid").agg(some(GONE, "gone"), some(WINDOWS, "windows")), ["id", "tid"], "left")
    missing = {k: F.lit(None).cast("array<binary>") for k in ("gone", "windows")}
    names = ["row", "text", "gone", "windows"]
    return joined.select(names).unionByName(keyed.where("id is null").withColumns(missing).select(names))


def _splitters(sized: DataFrame, size: int, buckets: int) -> np.ndarray:
    """Stretches that cut all of them into buckets of about equal size. They move work, not results.

    The sample grows with the number of buckets, and so does what the driver gets: some 3 KB a bucket.
    """
    wanted = buckets * SAMPLED_ROWS * THINNED * (WINDOW - KEY + 2) // 2  # bytes of text that have so many anchors
    share = min(1.0, max(wanted, SAMPLED_BYTES) / max(1, size))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in slices(batches, column=0):
            for s in stretches([t.encode() for t in texts_of(batch.column(0))]):
                at = np.arange(-seen % THINNED, len(s), THINNED)
                seen += len(s)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in s.rows(at)], pa.binary())], ["row"])

    some = sized.select("text").sample(share, 11).mapInArrow(frugal(drawn), "row binary").collect()
    rows = sorted(bytes(r.row) for r in some)
    at = np.linspace(0, len(rows), buckets + 1).astype(np.int64)[1:-1] if rows else ()
    return np.frombuffer(b"".join(sorted({rows[i] for i in at})), np.uint8).reshape(-1, ROW)


def kept_bytes(raw: bytes, removed: list[int]) -> bytes:
    """What is left of a text's bytes."""
    at, out = 0, []
    for a, b in zip(removed[::2], removed[1::2], strict=True):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _finished(docs: DataFrame, id_col: str, text_col: str, finish, schema: StructType) -> DataFrame:
    """``finish(text column, texts, removed runs)`` gives the columns of ``schema`` for each row of ``docs``; (row, those columns)."""
    names = ["row", *schema.names]

    def finished(batch: pa.RecordBatch, texts: list[bytes], removed: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *finish(batch.column(1), texts, removed)], names)

    marked = _marked(docs, id_col, text_col)
    return marked.mapInArrow(frugal(_spans(finished)), StructType([marked.schema["row"], *schema.fields]))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``removed``: the runs of bytes, start and end in turn, that repeat a smaller document.

    Ids are integers; null texts are empty; rows without id lose nothing. Repeated rows, and rows that share an id, do
    not count against each other. A column named ``removed`` is replaced, others may have any name. An empty table
    gives no rows.
    """
    docs = docs.drop("removed")
    schema = StructType().add("text", "string").add("removed", ArrayType(LongType()))
    found = _finished(docs, id_col, text_col, lambda text, _, removed: [text, pa.array(removed, pa.list_(pa.int64()))], schema)
    return found.select(*((F.col("text") if k == text_col else F.col("row").getField(k)).alias(k) for k in docs.columns), "removed")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``; the cases are those of :func:`repeated_spans`."""

    def finish(_: pa.Array, texts: list[bytes], removed: list[list[int]]) -> list[pa.Array]:
        kept = [kept_bytes(t, r) for t, r in zip(texts, removed, strict=True)]
        size, left = (np.array([len(t) for t in x], np.int64) for x in (texts, kept))
        spans = np.array([len(r) // 2 for r in removed], np.int64)
        return [pa.array(size), pa.array(size - left), pa.array(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]

    schema = StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    found = _finished(docs.select(id_col, text_col), id_col, text_col, finish, schema)
    return found.select(F.col("row").getField(id_col).alias(id_col), *schema.names)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text; a character cut in two goes as a whole. Columns stay."""

    def finish(text: pa.Array, texts: list[bytes], removed: list[list[int]]) -> list[pa.Array]:
        left = [kept_bytes(t, r).decode(errors="ignore") for t, r in zip(texts, removed, strict=True)]
        return [pa.array(left, pa.string(), mask=text.is_null().to_numpy(zero_copy_only=False))]

    found = _finished(docs, id_col, text_col, finish, StructType().add("left", "string"))
    return found.select(*((F.col("left") if k == text_col else F.col("row").getField(k)).alias(k) for k in docs.columns))
