"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model is compiled to a transducer of its character map, which rewrites the longest match at each place, to one of
its pieces, whose states are the beginnings of pieces, and to byte fallback for any other character. Composed with a
text they give an acyclic lattice of arcs over its characters; the encoding is the shortest path in the tropical
semiring, found place by place.

Unigram models weigh each arc by the piece's negative log-probability. In merge (BPE) models no weights on pieces give
the library's result; there a state is a place and the piece that ends at it, and an arc weighs nothing or, where
merging would not have left the boundary between two pieces alone, infinitely; one path of finite weight is left. No
piece crosses the places at which a normalised text is cut into units, so paths of units are found apart and kept in
a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.bpe import BoundedCache
from wayfold.llm.common import slices, small_batches, texts_of

MODEL = "piece_bpe_32k.model"
CACHED, PAIRS = 300_000, 300_000
SPACE = "▁"
#: Piece and model types, as the model format numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character costs beyond the least likely piece, as unigram models have it.
UNKNOWN_PENALTY = 10.0

# superscript digits count as word characters, but go with digits here
_LETTER = re.compile(r"[^\W\d_²³¹]")
_UNITS = re.compile(rf"{SPACE}*[^\W\d_²³¹]+|{SPACE}*(?:[^\w{SPACE}]|[\d_²³¹])+|{SPACE}+")
_WORDS = re.compile(SPACE + r"*[^" + SPACE + r"]+|" + SPACE + r"+")


def trie(words: dict[str, int | str]) -> dict:
    """The words as a deterministic transducer: a state is a dict from character to state, its output stands under ''."""
    root: dict = {}
    for word, output in words.items():
        state = root
        for c in word:
            state = state.setdefault(c, {})
        state[""] = output
    return root


def character_map(blob: bytes) -> dict[str, str]:
    """What a model's compiled character map rewrites: a double array of the keys' bytes, then the replacements.

    A unit of the array has its label in the low byte, whether a leaf hangs on it in bit 8, and the distance to its
    children above; a leaf has the place of the replacement, which a zero byte ends.
    """
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    children = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    out: dict[str, str] = {}
    open_states = [(children(units[0]), b"")]
    while open_states:
        at, key = open_states.pop()
        for label in range(1, 256):
            if at ^ label < len(units) and units[at ^ label] & 0x800000FF == label:
                unit, word = units[at ^ label], key + bytes([label])
                below = at ^ label ^ children(unit)
                if unit >> 8 & 1:
                    place = units[below] & 0x7FFFFFFF
                    out[word.decode(errors="replace")] = texts[place : texts.index(b"\0", place)].decode(errors="replace")
                open_states.append((below, word))
    return out


@dataclass
class Transducer:
    """The compiled model; plain tables, so that it can be broadcast."""

    kind: int
    pieces: list[str]
    cost: list[float]  # unigram: of an arc; merges: the rank of the piece
    arcs: dict[str, int]  # what the piece transducer accepts
    states: dict  # the piece transducer
    rewrites: dict  # the normaliser's transducer; empty: it copies
    byte_ids: list[int]  # of the 256 bytes; empty without byte fallback
    unknown: int
    dummy_prefix: bool
    trim: bool
    escape: bool
    apart: bool  # letters and other characters never share a piece
    halves: dict[int, tuple[int, int]]  # merges: what a piece was last merged from
    unused: set[int]  # pieces that an encoding may not have: their halves stand for them

    # ---- compilation

    @classmethod
    def load(cls, path: str) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            return cls.compile(sentencepiece_model_pb2.ModelProto.FromString(f.read()))

    @classmethod
    def compile(cls, model) -> Transducer:
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type not in (UNIGRAM, BPE) or spec.treat_whitespace_as_suffix:
            raise NotImplementedError("unigram and BPE models with white space before words only")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise NotImplementedError("user-defined symbols")
        pieces = [p.piece for p in model.pieces]
        unused = {i for i, p in enumerate(model.pieces) if p.type == UNUSED}
        if unused and spec.model_type == UNIGRAM:
            raise NotImplementedError("unused pieces of a unigram model")
        arcs = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
        bodies = [p.lstrip(SPACE) for p in arcs]
        apart = all(len({bool(_LETTER.match(c)) for c in p}) < 2 for p in bodies) and not any(SPACE in p for p in bodies)
        self = cls(
            kind=spec.model_type,
            pieces=pieces,
            cost=[-p.score for p in model.pieces],
            arcs=arcs,
            states=trie(arcs),
            rewrites=trie(character_map(norm.precompiled_charsmap)) if norm.precompiled_charsmap else {},
            byte_ids=[i for i, p in enumerate(model.pieces) if p.type == BYTE] if spec.byte_fallback else [],
            unknown=next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), 0),
            dummy_prefix=norm.add_dummy_prefix,
            trim=norm.remove_extra_whitespaces,
            escape=norm.escape_whitespaces,
            apart=apart,
            halves={},
            unused=unused,
        )
        if self.byte_ids and len(self.byte_ids) != 256:
            raise ValueError("byte fallback needs all 256 byte pieces")
        if self.kind == BPE:
            for piece, i in arcs.items():
                if len(piece) > 1:
                    parts = self.merged(piece, stop=True)
                    if len(parts) == 2:
                        self.halves[i] = (arcs[parts[0]], arcs[parts[1]])
        return self

    def merged(self, text: str, stop: bool = False) -> list[str]:
        """Merging by rank, leftmost first. With ``stop``, up to the merge that would make the whole text."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        left, arcs, cost = len(parts), self.arcs, self.cost
        waiting: list[tuple[float, int, str]] = []

        def wait(k: int) -> None:
            if k >= 0 and after[k] < len(parts):
                both = parts[k] + parts[after[k]]
                if both in arcs:
                    heapq.heappush(waiting, (cost[arcs[both]], k, both))

        for k in range(len(parts)):
            wait(k)
        while waiting and not (stop and left == 2):
            _, k, both = heapq.heappop(waiting)
            if parts[k] is None or after[k] >= len(parts) or len(parts[k]) + len(parts[after[k]]) != len(both):
                continue  # one of the two has been merged meanwhile
            gone = after[k]
            parts[k], parts[gone], after[k], left = both, None, after[gone], left - 1
            if after[k] < len(parts):
                before[after[k]] = k
            wait(before[k])
            wait(k)
        return [p for p in parts if p is not None]

    # ---- the normaliser

    def normalise(self, text: str) -> str:
        if self.rewrites:
            text = self.rewritten(text)
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def rewritten(self, text: str) -> str:
        """The normaliser's transducer composed with a text: the longest match at each place is rewritten, other characters stay."""
        out, at, root = [], 0, self.rewrites
        while at < len(text):
            state, end, found = root, at, None
            while end < len(text) and (state := state.get(text[end])) is not None:
                end += 1
                if "" in state:
                    found = end, state[""]
            out.append(text[at] if found is None else found[1])
            at = at + 1 if found is None else found[0]
        return "".join(out)

    # ---- composition and shortest path

    def lattice(self, unit: str, at: int) -> list[tuple[int, int]]:
        """The piece transducer composed with a text from a place on: arcs (next place, piece); -1 is a character outside the pieces."""
        out, state, end = [], self.states, at
        while end < len(unit) and (state := state.get(unit[end])) is not None:
            end += 1
            if "" in state:
                out.append((end, state[""]))
        return out if out and out[0][0] == at + 1 else [(at + 1, -1), *out]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def path(self, unit: str) -> list[int]:
        """Ids along the shortest path."""
        if self.kind == UNIGRAM:
            return self._least(unit)
        # ranks of whitespace runs tie, which only the merges themselves settle
        found = None if SPACE * 2 in unit else self._only(unit)
        if found is None:
            found = [self.arcs.get(p, p) for p in self.merged(unit)]
        return [i for x in found for i in (self.fallback(x) if isinstance(x, str) else self.used(x))]

    def used(self, piece: int) -> list[int]:
        """A piece, or what stands for it if it is unused."""
        if piece not in self.unused or piece not in self.halves:
            return [piece]
        return [i for half in self.halves[piece] for i in self.used(half)]

    def _least(self, unit: str) -> list[int]:
        """The least sum of weights leads to each place in turn; of equal ones, the first found."""
        unknown = max((self.cost[i] for i in self.arcs.values()), default=0.0) + UNKNOWN_PENALTY
        best: list[tuple[float, int, int]] = [(0.0, 0, -2)] + [(float("inf"), 0, -2)] * len(unit)
        for at in range(len(unit)):
            for end, i in reversed(self.lattice(unit, at)):
                cost = best[at][0] + (unknown if i < 0 else self.cost[i])
                if cost < best[end][0]:
                    best[end] = cost, at, i
        out, at = [], len(unit)
        while at:
            _, start, i = best[at]
            # unknown characters next to each other are one unknown piece
            if i >= 0 or self.byte_ids or not (out and out[-1] == [self.unknown] and at < len(unit)):
                out.append([i] if i >= 0 else self.fallback(unit[start:at]))
            at = start
        return [i for part in reversed(out) for i in part]

    def _only(self, unit: str) -> list[int | str] | None:
        """The path of weight zero: arcs between pieces that may not follow each other weigh infinitely.

        What merging makes of a beginning of the unit is the only way to its end, so each place has one state of
        finite weight, which the pieces that begin there extend. None if equal ranks leave no way.
        """
        n, states = len(unit), self.states
        pairs = self._pairs()
        last: list[int | None] = [-1] + [None] * n
        start = [0] * (n + 1)
        for at in range(n):
            left = last[at]
            if left is None:
                continue
            state, end, single = states, at, False
            while end < n and (state := state.get(unit[end])) is not None:
                end += 1
                i = state.get("")
                if i is not None:
                    single = single or end == at + 1
                    if last[end] is None and (left < 0 or pairs[left << 32 | i]):
                        last[end], start[end] = i, at
            if not single and last[at + 1] is None:
                last[at + 1], start[at + 1] = -1, at
        if last[n] is None:
            return None
        out, at = [], n
        while at:
            out.append(last[at] if last[at] >= 0 else unit[start[at] : at])
            at = start[at]
        return out[::-1]

    def _pairs(self) -> BoundedCache:
        """Whether a piece may follow another, by both numbers."""
        if not hasattr(self, "_cached_pairs"):
            self._cached_pairs = BoundedCache(lambda k: self._stays(k >> 32, k & 0xFFFFFFFF), PAIRS)
        return self._cached_pairs

    def _stays(self, left: int, right: int) -> bool:
        """Whether merging leaves the boundary between two pieces alone.

        Undo the merges inside both, the latest first; at no stage may the pieces that then meet at the boundary
        merge sooner than the merge that was undone. On equal ranks the one further left goes first.
        """
        pieces, arcs, cost, halves = self.pieces, self.arcs, self.cost, self.halves
        undone, at_left = float("inf"), False
        while True:
            both = arcs.get(pieces[left] + pieces[right])
            if both is not None:
                rank = cost[both]
                if rank < undone or (rank == undone and not at_left):
                    return False
            a, b = left in halves, right in halves
            if not a and not b:
                return True
            if a and (not b or cost[left] > cost[right]):
                undone, at_left = cost[left], True
                left = halves[left][1]
            else:
                undone, at_left = cost[right], False
                right = halves[right][0]

    def units(self, text: str) -> list[str]:
        """Stretches of a normalised text that no piece crosses."""
        if not self.escape or self.kind == UNIGRAM and not self.apart:
            return [text] if text else []
        return (_UNITS if self.apart else _WORDS).findall(text)

    def packed(self, unit: str) -> bytes:
        return np.asarray(self.path(unit), "<u4").tobytes()

    def encode(self, text: str | None) -> list[int]:
        return [i for u in self.units(self.normalise(text or "")) for i in self.path(u)]

    # ---- the inverse

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the inverse transducer. Stretches of bytes that aren't UTF-8 give replacement characters."""
        table = self._texts()
        out = b"".join(map(table.__getitem__, ids)).decode(errors="replace")
        out = out.replace(SPACE, " ") if self.escape else out
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out

    def _texts(self) -> list[bytes]:
        if not hasattr(self, "_cached_texts"):
            table = [p.encode() for p in self.pieces]
            for b, i in enumerate(self.byte_ids):
                table[i] = bytes([b])
            self._cached_texts = table
        return self._cached_texts


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every row of ``docs``: the ids of the whole text. A null or empty text has none."""
    return _mapped(docs, path, id_col, text_col, ids=True)


def encode_and_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, round_trip) for every row of ``docs``.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` that of the
    text decoded from them; ``round_trip`` tells whether that is the text again. A null text counts as empty,
    with no pieces. Repeated rows give equal rows; an empty table gives none; other columns are not read.
    """
    return _mapped(docs, path, id_col, text_col, ids=False)


def _mapped(docs: DataFrame, path: str | None, id_col: str, text_col: str, ids: bool) -> DataFrame:
    compiled = docs.sparkSession.sparkContext.broadcast(Transducer.load(path or public_tokenizers.path(MODEL)))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled.value
        known = BoundedCache(t.packed, CACHED)
        byte = np.zeros(len(t.pieces), bool)
        byte[t.byte_ids] = True
        for batch in slices(batches, column=1):
            raws, rows = [], []
            for text in texts_of(batch.column(1)):
                text = text or ""
                raw = b"".join(map(known.__getitem__, t.units(t.normalise(text))))
                raws.append(raw)
                if not ids:
                    found = np.frombuffer(raw, "<u4")
                    back = t.decode(found.tolist())
                    rows.append((len(found), int(byte[found].sum()), zlib.crc32(raw), hashlib.sha256(back.encode()).hexdigest(), back == text))
            if ids:
                ends = np.cumsum([0, *(len(r) // 4 for r in raws)]).astype(np.int32)
                values = np.frombuffer(b"".join(raws), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], [id_col, "ids"])
            else:
                kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "round_trip"])

    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = chosen.schema[0].dataType.simpleString()
    rest = "ids array<int>" if ids else "n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return small_batches(chosen).mapInArrow(mapped, f"`{id_col}` {kind}, {rest}")
