"""Self-join of texts on the Jaccard similarity of their word shingles, as a T-occurrence search.

Two sets of a and b shingles are similar if they share at least T of them. Inverted lists (shingle -> texts) are
merged from the sorted runs of packed blocks, bucket by bucket. Shingles with one and the same list (the words of a
passage, the unchanged parts of near copies) count as one list with a weight. Shingles of a single text have no list,
and a text whose lists weigh less than T can have no partner and is dropped there.

As DivideSkip has it, the longest lists, T - 1 of them by weight, are set aside. Texts that meet in the short rest are
candidates; a candidate's occurrences in the short lists are counted, and only if the long ones could still make up
for what lacks of T are those looked up by binary search in its sorted set.

Within a list, a pivot is tried first, and pairs across components only, so a large group of copies costs a star
rather than all pairs. More pivots follow each round. Lists whose texts have few lists to share next are split by
those instead: two texts that need more occurrences than the lists met so far must meet in one of them, too. So texts
made of common passages do not meet in pairs for each passage. Nothing is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayfold.llm.bpe import BoundedCache
from wayfold.llm.common import discard, frugal, planes, small_batches, stash, texts_of, unplanes
from wayfold.llm.graph import components

WORDS, PERCENT = 5, 80
#: Words gathered before a block of postings is sent on.
BLOCK = 1_000_000
#: Bytes of text whose postings share a bucket.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64
#: Buckets that one task merges at most, unless there are too few tasks for all cores.
BUCKETS_A_TASK = 16
#: A block that has a shingle in so many classes sends its number of them, and keeps their names until lengths come back.
HEAVY = 16
#: Pairs across components that each text of a list may be tried with, on average, before pivots are or the list is split.
FEW = 6
#: A list is split if its texts have so many lists to share next, on average; of near copies, which share all, they have more.
NEXT, DEPTH = 8, 8
CACHED = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: A list in a text's set: its hash, its length, and how many of the text's shingles have it.
_LIST = np.dtype([("h", "<u8"), ("f", "<u4"), ("w", "<u4")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    h = (h ^ (h >> np.uint64(29))) * _ODD[4]
    return h ^ (h >> np.uint64(32))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, split at the six ASCII white-space characters."""
    return text.encode().lower().split() if text else []


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of WORDS words; of the whole sequence if it is shorter; none of no words."""
    n = len(hashes)
    if n < WORDS:
        return _mix(np.array([np.uint64(n) + (hashes * _ODD[:n]).sum(dtype=np.uint64)], np.uint64)) if n else hashes
    return _mix(sum(hashes[k : n - WORDS + 1 + k] * _ODD[k] for k in range(WORDS)))


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


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the first one first, and where groups of equal keys start in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        k = k[order]
        new |= k[1:] != k[:-1]
    return order, np.flatnonzero(np.append(True, new))[: len(order)]


def _members(keys: np.ndarray, start: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of the set of ``values`` in each group, which starts as said."""
    return np.add.reduceat(_mix(values ^ _ODD[0]), start) if len(start) else np.zeros(0, np.uint64)


_NAMES = ["bucket", "kind", "block", "id", "cls", "n", "data"]
#: Kinds of row: a text and its class; postings for a bucket; what a block keeps of its heavy shingles; lengths of those; lists of classes; classes that another block answers for.
TEXT, POSTINGS, KEPT, LENGTHS, LISTS, ELSEWHERE = range(6)


def _rows(id_type: pa.DataType, kind: int, bucket, size: int, block=None, id=None, cls=None, n=None, data=None) -> pa.RecordBatch:
    made = [pa.array(np.broadcast_to(np.asarray(bucket, np.int32), size)), pa.array(np.full(size, kind, np.int8))]
    block = None if block is None else pa.array(np.broadcast_to(np.asarray(block, np.int64), size))
    for value, t in ((block, pa.int64()), (id, id_type), (cls, pa.int64()), (n, pa.int32()), (data, pa.binary())):
        made.append(pa.nulls(size, t) if value is None else value)
    return pa.RecordBatch.from_arrays(made, _NAMES)


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : end])
        at = end
    return out


def _lists_of(owner: np.ndarray, h: np.ndarray, f: np.ndarray, w: np.ndarray, table: tuple[np.ndarray, ...], buckets: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The lists of classes, packed by the bucket that gathers a class; a class's entries of one list are summed.

    ``table`` has the class, its size and the block that answers for it, of each owner.
    """
    classes, sizes, blocks = table
    order, start = _grouped(owner, h)
    w = np.add.reduceat(w[order], start) if len(start) else w[:0]
    owner, h, f = owner[order][start], h[order][start], f[order][start]
    to = (classes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)[owner]
    order = np.argsort(to, kind="stable")
    to, owner, h, f, w = (x[order] for x in (to, owner, h, f, w))
    cut = np.searchsorted(to, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        part = slice(cut[b], cut[b + 1])
        who, at = np.unique(owner[part], return_inverse=True)
        data = _joined([_pack(classes[who], sizes[who].astype(np.uint32), blocks[who]), _pack(at.astype(np.uint32), h[part], f[part].astype(np.uint32), w[part].astype(np.uint32))])
        yield _rows(id_type, LISTS, b, 1, data=pa.array([data], pa.binary()))


def _blocks(buckets: int, id_type: pa.DataType):
    """Task function: (id, text) -> rows of the kinds TEXT, POSTINGS and KEPT."""

    def flush(task: int, number: int, ids: list[pa.Array], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        block = xxhash.xxh64_intdigest(f"{task}-{number}") >> 1
        home = block % buckets
        filled = np.array([len(t) > 0 for t in texts], bool)
        key = np.array([xxhash.xxh3_64_intdigest(t.tobytes()) if len(t) else 0 for t in texts], np.uint64).view(np.int64)
        known, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        made = [shingles(texts[i]) for i in first]
        owner = np.repeat(np.arange(len(first), dtype=np.uint32), [len(m) for m in made])
        shingle = np.concatenate(made) if made else np.zeros(0, np.uint64)
        del made
        order = np.argsort(shingle, kind="stable")
        shingle, owner = shingle[order], owner[order]
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1]))[: len(shingle)]
        shingle, owner = shingle[new], owner[new]
        sizes = np.bincount(owner, minlength=len(first)).astype(np.uint32)
        n = np.where(filled, sizes[inverse], 0).astype(np.int32)
        yield _rows(id_type, TEXT, (home + np.arange(len(texts))) % buckets, len(texts), id=pa.concat_arrays(ids), cls=pa.array(key, mask=~filled), n=pa.array(n))
        if not len(shingle):
            return
        start = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        count = np.diff(np.append(start, len(shingle)))
        much = count >= HEAVY
        heavy = np.repeat(much, count)
        top, total = shingle[start[much]], count[much].astype(np.uint32)
        names = known.view(np.uint64)
        member = names[owner[heavy]]
        begins = (np.cumsum(total, dtype=np.int64) - total).astype(np.int64)
        sums = _members(member, begins, member)
        if len(top):
            # shingles with the same classes here are named once for all of those
            order, starts = _grouped(sums, total)
            group = np.empty(len(top), np.uint32)
            group[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
            leader = np.zeros(len(top), bool)
            leader[order[starts]] = True
            named = np.repeat(leader, total)
            whose, which = owner[heavy][named], np.repeat(group, total)[named]
            who, at = np.unique(whose, return_inverse=True)
            data = _joined([_pack(top, group), _pack(known[who], sizes[who]), _pack(at.astype(np.uint32), which)])
            yield _rows(id_type, KEPT, home, 1, block, data=pa.array([data], pa.binary()))
        shingle, owner = shingle[~heavy], owner[~heavy]
        edges = (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets)
        cut, cut_top = (np.searchsorted(x >> np.uint64(32), edges) for x in (shingle, top))
        to = (names % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut_names = np.searchsorted(to[order], np.arange(buckets + 1))
        for b in range(buckets):
            h, o = shingle[cut[b] : cut[b + 1]], owner[cut[b] : cut[b + 1]]
            t = slice(cut_top[b], cut_top[b + 1])
            mine = known[order[cut_names[b] : cut_names[b + 1]]]
            if len(h) or len(top[t]) or len(mine):
                who, o = np.unique(o, return_inverse=True)
                data = _joined([_pack(known[who], sizes[who]), _pack(h, o.astype(np.uint32)), _pack(top[t], total[t], sums[t]), _pack(np.sort(mine))])
                yield _rows(id_type, POSTINGS, b, 1, block, data=pa.array([data], pa.binary()))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task, number = BoundedCache(word_hash, CACHED), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for batch in batches:
            start = 0
            for i, text in enumerate(texts_of(batch.column(1))):
                found = words_of(text)
                texts.append(np.fromiter(map(cache.__getitem__, found), np.uint64, len(found)))
                size += len(found)
                if size >= BLOCK:
                    yield from flush(task, number, [*ids, batch.column(0)[start : i + 1]], texts)
                    ids, texts, size, number, start = [], [], 0, number + 1, i + 1
            ids.append(batch.column(0)[start:])
        if texts:
            yield from flush(task, number, ids, texts)

    return blocks


def _merge(buckets: int, id_type: pa.DataType):
    """Group function: one bucket, whose blocks' sorted runs are merged into inverted lists -> lists of classes, lengths for the blocks."""

    def merged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = table.column("kind").to_numpy()
        postings = table.filter(pa.array(kind == POSTINGS))
        blocks = postings.column("block").to_numpy()
        light, heavy, names = [], [], []
        for k, data in enumerate(postings.column("data")):
            known, runs, tops, mine = _parted(data.as_py())
            who, n = _unpack(known, np.int64, np.uint32)
            h, o = _unpack(runs, np.uint64, np.uint32)
            light.append((h, who[o], n[o], np.full(len(h), blocks[k])))
            top, total, sums = _unpack(tops, np.uint64, np.uint32, np.uint64)
            heavy.append((top, total, sums, np.full(len(top), k)))
            (mine,) = _unpack(mine, np.int64)
            names.append((mine, np.full(len(mine), k)))
        if not light:
            return
        h, c, n, by = (np.concatenate(x) for x in zip(*light, strict=True))
        top, total, sums, block = (np.concatenate(x) for x in zip(*heavy, strict=True))
        del light, heavy
        hot = np.unique(top)
        order = np.argsort(h, kind="stable")  # a merge of the runs that the blocks have sorted
        h = h[order]
        same = h[1:] == h[:-1]
        near = (np.append(same, False) | np.append(False, same))[: len(h)]
        if len(hot):
            near |= hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        h, order = h[near], order[near]
        c, n, by = c[order], n[order], by[order]
        # of blocks that post one class, the first answers for it
        order = np.lexsort((by, c, h))
        h, c, n, by = h[order], c[order], n[order], by[order]
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))[: len(h)]
        h, c, n, by = h[new], c[new], n[new], by[new]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))[: len(h)]
        # every list: its shingle, length and hash, from names and from the blocks' sums alike
        named = np.concatenate([h[start], top])
        length = np.concatenate([np.diff(np.append(start, len(h))), total.astype(np.int64)])
        which = np.concatenate([_members(h, start, c.view(np.uint64)), sums])
        order, starts = _grouped(named)
        if len(starts):
            named, length, which = named[order][starts], np.add.reduceat(length[order], starts), np.add.reduceat(which[order], starts)
        f = np.minimum(length, 0xFFFFFFFF).astype(np.uint32)
        if len(h):
            at = np.searchsorted(named, h)
            keep = length[at] >= 2
            c, n, by, at = c[keep], n[keep], by[keep], at[keep]
            order, start = _grouped(c, by)
            owner = np.empty(len(c), np.int64)
            owner[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
            table = c[order][start], n[order][start], by[order][start]
            yield from _lists_of(owner, which[at], f[at], np.ones(len(at), np.uint32), table, buckets, id_type)
        for k in np.unique(block):
            mine = np.sort(top[block == k])
            at = np.searchsorted(named, mine)
            yield _rows(id_type, LENGTHS, 0, 1, blocks[k], data=pa.array([_pack(mine, f[at], which[at])], pa.binary()))
        mine, block = (np.concatenate(x) for x in zip(*names, strict=True))
        order = np.lexsort((blocks[block], mine))
        again = np.append(False, mine[order][1:] == mine[order][:-1])[: len(order)]
        mine, block = mine[order][again], block[order][again]
        for k in np.unique(block):
            yield _rows(id_type, ELSEWHERE, 0, 1, blocks[k], data=pa.array([_pack(mine[block == k])], pa.binary()))

    def merge(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        done = table.filter(pa.array((kind == TEXT) | (kind == KEPT))).select(_NAMES)
        out = [done.cast(pa.schema([pa.field(k, t) for k, t in zip(_NAMES, [pa.int32(), pa.int8(), pa.int64(), id_type, pa.int64(), pa.int32(), pa.binary()], strict=True)]))]
        return pa.concat_tables([*out, *(pa.Table.from_batches([b]).cast(out[0].schema) for b in merged(table))])

    return merge


def _heavy(buckets: int, id_type: pa.DataType):
    """Group function: a block's heavy shingles with the lengths that came back -> lists of the classes that it answers for."""

    def lists(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        some = lambda k: [x.as_py() for x in table.filter(pa.array(kind == k)).column("data")]
        out = [_rows(id_type, LISTS, 0, 0)]
        for kept in some(KEPT):
            known, owners = _parted(kept)[1:]
            top, group = _unpack(_parted(kept)[0], np.uint64, np.uint32)
            classes, sizes = _unpack(known, np.int64, np.uint32)
            owner, which = _unpack(owners, np.uint32, np.uint32)
            h, f, lists = (np.concatenate(x) for x in zip(*(_unpack(x, np.uint64, np.uint32, np.uint64) for x in some(LENGTHS)), strict=True))
            order = np.argsort(h)
            at = order[np.searchsorted(h[order], top)]
            # the lists of each group of shingles, then each class's groups
            order, start = _grouped(group, lists[at])
            weight = np.diff(np.append(start, len(order)))
            of, name, length = group[order][start], lists[at][order][start], f[at][order][start]
            first = np.searchsorted(of, np.arange(int(group.max()) + 2))
            each = np.diff(first)[which]
            item = np.repeat(first[which], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            owner = np.repeat(owner, each)
            gone = [_unpack(x, np.int64)[0] for x in some(ELSEWHERE)]
            if gone:
                stay = ~np.isin(classes, np.concatenate(gone))[owner]
                owner, item = owner[stay], item[stay]
            block = np.full(len(classes), table.column("block")[0].as_py())
            out += _lists_of(owner, name[item], length[item], weight[item].astype(np.uint32), (classes, sizes, block), buckets, id_type)
        return pa.Table.from_batches(out).select(["bucket", "data"])

    return lists


def _needed(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any partner, at least."""
    return -(-percent * n // 100)


def _short(w: np.ndarray, slack: int) -> np.ndarray:
    """(weight before, further places within reach) of each list, in order, that is not among the longest set aside.

    A partner may lack ``slack`` of all shingles that have a list, so it has one of these lists at least.
    """
    before = np.cumsum(w) - w
    n = int(np.searchsorted(before, slack, "right"))
    # from a list on, those that can be the next one a partner shares
    reach = np.searchsorted(before, slack + w[:n].astype(np.int64), "right") - np.arange(1, n + 1)
    return np.stack([before[:n], np.maximum(reach, 0)], 1)


def _gather(percent: int):
    """Group function: lists of classes -> (cls, n, own, lists, short) of those that can have a partner.

    ``own`` counts the shingles of no other text. ``lists`` are ordered by length, ties by hash, alike in all texts.
    """

    def gather(table: pa.Table) -> pa.Table:
        parts = []
        for data in table.column("data"):
            known, entries = _parted(data.as_py())
            who, n, by = _unpack(known, np.int64, np.uint32, np.int64)
            at, h, f, w = _unpack(entries, np.uint32, np.uint64, np.uint32, np.uint32)
            parts.append((who[at], n[at], by[at], h, f, w))
        cls, n, by, h, f, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        # a class that several blocks have counts once, as the first of them has it
        order = np.lexsort((by, cls))
        first = np.append(True, cls[order][1:] != cls[order][:-1])
        home = np.empty(len(cls), np.int64)
        home[order] = by[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        stay = by == home
        cls, n, h, f, w = cls[stay], n[stay], h[stay], f[stay], w[stay]
        order, start = _grouped(cls, h)
        # a class's entries of one list come from different buckets, whose shingles differ
        w, cls, n, h, f = np.add.reduceat(w[order].astype(np.int64), start), cls[order][start], n[order][start], h[order][start], f[order][start]
        order = np.lexsort((h, f, cls))
        cls, n, h, f, w = (x[order] for x in (cls, n, h, f, w))
        first = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        columns = [[], [], [], [], []]
        for a, b in zip(first, np.append(first[1:], len(cls)), strict=True):
            size, shared = int(n[a]), int(w[a:b].sum())
            slack = shared - _needed(size, percent)
            if slack < 0:
                continue
            entry = np.empty(b - a, _LIST)
            entry["h"], entry["f"], entry["w"] = h[a:b], f[a:b], w[a:b]
            short = _short(w[a:b], slack)
            for column, x in zip(columns, (int(cls[a]), size, size - shared, entry.tobytes(), [{"h": int(y), "w": int(v), "before": int(s), "next": int(r)} for y, v, (s, r) in zip(h[a:b].view(np.int64), w[a:b], short, strict=False)]), strict=True):
                column.append(x)
        item = pa.struct([("h", pa.int64()), ("w", pa.int32()), ("before", pa.int32()), ("next", pa.int32())])
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(item)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["cls", "n", "own", "lists", "short"])

    return gather


_SETS = "cls long, n int, own int, lists binary, short array<struct<h: long, w: int, before: int, next: int>>"


def occurrences(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int) -> int:
    """How often ``b`` occurs in the lists of ``a``; 0 as soon as that can't reach what a link takes.

    The short lists are counted first; the longest, T - 1 of all by weight, are probed only if they can make up the rest.
    """
    t = -(-percent * (na + nb) // (100 + percent))
    names = np.sort(b["h"])
    there = lambda x: names[np.minimum(np.searchsorted(names, x["h"]), len(names) - 1)] == x["h"]
    aside = np.searchsorted(np.cumsum(a["w"][::-1], dtype=np.int64), t, "left")  # of the end, those below T in all
    short, long = a[: len(a) - aside], a[len(a) - aside :]
    n = int(short["w"][there(short)].sum())
    if n + int(long["w"].sum()) < t:
        return 0
    return n + int(long["w"][there(long)].sum())


def _probe(percent: int):
    """Task function: pairs with the lists of both -> the pairs that link."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in ("a", "b", "na", "nb"))
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                n = occurrences(np.frombuffer(x.as_buffer(), _LIST), int(na[i]), np.frombuffer(y.as_buffer(), _LIST), int(nb[i]), percent)
                keep[i] = 100 * n >= percent * (int(na[i]) + int(nb[i]) - n)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return probe


def _split(percent: int):
    """Task function: rows of a list with their text's lists -> a row for each list that a partner, met in this one, may share next."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            h, n, r, w, at, comp, depth, cls = (batch.column(k).to_numpy() for k in ("h", "n", "r", "w", "at", "comp", "depth", "cls"))
            for i, x in enumerate(batch.column("lists")):
                e = np.frombuffer(x.as_buffer(), _LIST)[at[i] + 1 :]
                before = np.cumsum(e["w"], dtype=np.int64) - e["w"]
                slack = int(r[i]) - _needed(int(n[i]), percent)  # of what can still be shared, the lists met included
                k = int(np.searchsorted(before, slack, "right"))
                reach = np.searchsorted(before, slack + e["w"][:k].astype(np.int64), "right") - np.arange(1, k + 1)
                key = _mix(e["h"][:k] * _ODD[1] + h[i : i + 1].view(np.uint64)).view(np.int64)
                out.append((key, np.full(k, cls[i]), np.full(k, n[i]), r[i] - before[:k], w[i] + e["w"][:k].astype(np.int64), at[i] + 1 + np.arange(k), np.maximum(reach, 0), np.full(k, comp[i]), np.full(k, depth[i] + 1)))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["h", "cls", "n", "r", "w", "at", "next", "comp", "depth"])

    return split


_MET = ["h", "cls", "n", "r", "w", "at", "next", "comp", "depth"]


def _links(sets: DataFrame, percent: int) -> tuple[DataFrame | None, list[int]]:
    """(v, c), the component of every class that links with another, or None if none does; and the pairs tried in each round.

    A row of ``lists`` is a text in a list, or in several that texts met in turn: r bounds what it can share with others
    there, w is what the lists met weigh.
    """
    lists = sets.select(F.col("cls"), "n", "own", F.posexplode("short").alias("at", "s")).select(
        F.col("s.h").alias("h"), "cls", "n", (F.col("n") - F.col("own") - F.col("s.before")).alias("r"), F.col("s.w").alias("w"), "at", F.col("s.next").alias("next"), F.col("cls").alias("comp"), F.lit(False).alias("whole"), F.lit(1).alias("depth")
    )
    total = sets.agg(F.sum(F.size("short"))).first()[0] or 0
    lists = stash(lists, "lists", total)
    edges = labels = None
    number, counts = 0, []
    while True:
        lacks = F.col("n") - F.col("r")
        by_comp = lists.groupBy("h", "comp").agg(F.count("*").cast("double").alias("m"), F.min(lacks).alias("lacks"), F.sum("next").alias("next"), F.max("whole").alias("whole"), F.max("depth").alias("depth"))
        of = by_comp.groupBy("h").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.min("lacks").alias("lacks"), F.sum("next").alias("next"), F.max_by("comp", "m").alias("most"), F.count("*").alias("comps"), F.max("whole").alias("done"), F.max("depth").alias("d"))
        each = (F.col("m") * F.col("m") - F.col("mm")) / F.col("m")  # pairs across components that a text has on average
        few = F.lit(number > 0) & ((each <= FEW) | (~F.col("done") & (each <= F.col("next") / F.col("m"))))
        split = F.lit(number > 0) & ~few & ~F.col("done") & (F.col("next") <= NEXT * F.col("m")) & (F.col("d") < DEPTH)
        stats = stash(of.where("comps > 1").select("h", "lacks", "most", few.alias("few"), split.alias("split")), "sizes")
        # a text whose best partner here couldn't share enough has none here
        old, lists = lists, stash(lists.join(stats.withColumnRenamed("lacks", "least"), "h").where(100 * F.col("r") >= percent * (F.col("n") + F.col("least"))), "met", total)
        discard(old, stats)
        if not lists.limit(1).count():
            return labels, counts
        pivots = stash(_pivots(lists, number), "pivots", total)
        tried = stash(_tried(lists, pivots, percent, number), "tried", total)
        counts.append(tried.count())
        side = lambda k: sets.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("lists").alias(f"s{k}"))
        found = stash(small_batches(tried).join(side("b"), "b").join(side("a"), "a").mapInArrow(frugal(_probe(percent)), "a long, b long"), "found", counts[-1], 2000)
        again = lists.where("split")
        left = lists.where("not few and not split").join(pivots.select("h", "cls"), ["h", "cls"], "left_anti").select(*_MET, "whole")  # pivots have met all others
        if number:
            parts = again.join(sets.select("cls", "lists"), "cls").mapInArrow(frugal(_split(percent)), "h long, cls long, n int, r int, w int, at int, next int, comp long, depth int")
            enough = again.where(100 * F.col("w") >= percent * F.col("n"))  # may link without a further list
            left = left.unionByName(parts.withColumn("whole", F.lit(False))).unionByName(enough.select(*_MET, F.lit(True).alias("whole")))
        if found.limit(1).count():
            edges = found if edges is None else edges.unionByName(found)
            labels = components(edges)
            left = left.drop("comp").join(labels.select(F.col("v").alias("cls"), F.col("c").alias("to")), "cls", "left")
            left = left.withColumn("comp", F.coalesce("to", "cls")).select(*_MET, "whole")
        old, lists = lists, stash(left, "lists", total)
        discard(old, pivots, tried)
        total = lists.count()
        number += 1


def _pivots(lists: DataFrame, number: int) -> DataFrame:
    """(h, cls, n, r, comp): a text of each list that isn't short of pairs; more of those that aren't split, the more the later."""
    slots = F.when(F.col("split"), 1).otherwise(F.lit(8 ** min(number, 7)))
    slot = F.pmod(F.xxhash64("cls", F.lit(number)), slots)
    # the text that lacks least of what is shared is the likeliest to be what others were copied from
    least = F.min(F.struct(F.col("n") - F.col("r"), "cls", "n", "r", "comp")).alias("p")
    return lists.where("not few").groupBy("h", slot.alias("slot")).agg(least).select("h", "p.cls", "p.n", "p.r", "p.comp")


def _tried(lists: DataFrame, pivots: DataFrame, percent: int, number: int) -> DataFrame:
    """Pairs (a, b) across components: all of lists with few of them, of others the pairs with pivots."""
    fits = lambda x, y: (100 + percent) * F.least(f"{x}r", f"{y}r") >= percent * (F.col(f"{x}n") + F.col(f"{y}n"))
    other = lambda df, p: df.select("h", *(F.col(k).alias(f"{p}{k}") for k in ("cls", "n", "r", "comp")))
    met = lists.where("not few").join(other(pivots, "p_"), "h").where((F.col("comp") != F.col("p_comp")) & fits("", "p_"))
    pairs = met.select(F.least("cls", "p_cls").alias("a"), F.greatest("cls", "p_cls").alias("b"))
    if number:
        some = lists.where("few")
        lone = other(some.where("comp <> most"), "q_")
        met = some.join(lone, "h").where((F.col("comp") != F.col("q_comp")) & ((F.col("comp") == F.col("most")) | (F.col("cls") < F.col("q_cls"))) & fits("", "q_"))
        pairs = pairs.unionByName(met.select(F.least("cls", "q_cls").alias("a"), F.greatest("cls", "q_cls").alias("b")))
    return pairs.distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Two texts link when 100 * intersection >= percent * union of their sets of distinct 5-word shingles; the
    component is the smallest id that links lead to. Texts with the same words are one class throughout, so
    copies and repeated rows cost one row each. Null, empty and blank texts have an empty set and link with
    nothing. Very long texts are taken whole. Shingles, classes and lists are compared by 64-bit hashes. An empty
    table gives no rows; other columns are not read, whatever their names.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema[0].dataType.simpleString()
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    id_type = to_arrow_type(chosen.schema[0].dataType)
    schema = f"bucket int, kind tinyint, block long, id {kind}, cls long, n int, data binary"
    posted = small_batches(chosen).mapInArrow(frugal(_blocks(buckets, id_type)), schema).repartition(buckets, "bucket")
    # a task takes several buckets, one after another, so that no flood of small files is written
    tasks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, buckets // BUCKETS_A_TASK)
    merged = stash(posted.groupBy("bucket").applyInArrow(_merge(buckets, id_type), schema).coalesce(tasks), "merged")
    members = merged.where(f"kind = {TEXT}").select("id", "cls", "n")
    by_block = merged.where(F.col("kind").isin(KEPT, LENGTHS, ELSEWHERE)).select("block", "kind", "data")
    lists = merged.where(f"kind = {LISTS}").select("bucket", "data").unionByName(by_block.groupBy("block").applyInArrow(_heavy(buckets, id_type), "bucket int, data binary"))
    sets = stash(lists.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_gather(percent), _SETS).coalesce(tasks), "sets")
    labels, _ = _links(sets, percent)
    ids = members.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"))
    if labels is not None:
        ids = stash(ids.join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("c", F.coalesce("c", "cls")), "ids")
        least = stash(ids.groupBy("c").agg(F.min("least").alias("component_id")), "least")
        ids = ids.join(least, "c").select("cls", "component_id")
    else:
        ids = ids.withColumnRenamed("least", "component_id")
    ids = stash(ids, "ids")
    discard(sets)
    return members.join(ids, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
