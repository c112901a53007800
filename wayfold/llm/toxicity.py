"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, on all labelled rows.

Words and their stems (beginnings shorter than the word) are hashed to buckets, buckets have small embeddings, a
word's is the sum of those of its buckets; filters of several widths slide over the words, each filter's maximum over
the text feeds a logistic output. Decision thresholds are calibrated by language, over
all of them where no cut pays in a language, and the language of a text is read from its words, as the language column is no input of a score.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.llm.bpe import BoundedCache
from wayfold.llm.common import crc_bucket, discard, frugal, give_back, planes, slices, small_batches, stash, texts_of, unplanes

#: Labelled rows that the driver fits on: this many of either label at most, chosen by a hash of the id. With more of them, tasks go on from there.
SAMPLE_PER_LABEL = 2000
#: Words of those rows in all: of very long texts, the driver leaves rows beyond it in the order of the hash to the tasks.
SAMPLE_WORDS = 8_000_000
#: Passes of the tasks over all labelled rows, and words that a task goes over before weights are averaged.
PASSES, SHARD_WORDS = 1, 2_000_000
#: Bits for each labelled id of the map that keeps most texts without a label from being shuffled, and bits of that map at most.
ID_BITS, MAP_BITS = 16, 1 << 27
#: Parts of one by which logits of all labelled rows are told apart for the thresholds, and the size at which they are clipped.
GRID, FARTHEST = 256, 64.0
BUCKETS = 1 << 20
#: Distinct buckets of documents that a task gathers before it counts them, and counts that it keeps at most.
GATHERED, COUNTED = 3_000_000, 1_500_000
#: Ranges of buckets whose counts are summed together, or of rows whose weights are, at least, and shards of words that give one more.
LEAST_RANGES, SHARDS_A_RANGE = 64, 16
#: Shards whose weights a task adds up, where that leaves so many tasks at least.
SHARDS_A_TASK, LEAST_TASKS = 8, 12
#: Lengths of the stems that a word has beside itself, in characters; a stem is shorter than its word.
STEMS = (4, 5, 6, 7)
WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 8
#: Buckets seen in fewer sampled documents share one row, whose embedding stays zero.
LEAST_DOCUMENTS = 3
#: Standard deviations between a bucket's toxic documents and their expected number from which its log-odds are used.
LEAST_DEVIATION = 3.5
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
#: Share of the words that a training step hides, so that none relies on the company of others.
HIDDEN = 0.5
#: Words that are put through the filters at once, and words that a worker remembers.
SLICE = 16_384
CACHED = 250_000
#: Words whose unknown ones are looked up together, and bytes that a word has at most for that.
READ, LETTERS = 200_000, 64
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»…“”‘’–—|"


def features(word: str) -> tuple[int, ...]:
    """The buckets of a word and of its stems; -1 where the word is too short for a stem."""
    word = word.lower().strip(_MARKS)
    size, crc = len(word), zlib.crc32
    return (crc(word.encode()) % BUCKETS, *[crc((word[:k] + " ").encode()) % BUCKETS if size > k else -1 for k in STEMS])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_CRC, _LOW = _crc_table(), np.uint32(255)


def features_of(words: Sequence[str]) -> np.ndarray:
    """:func:`features` of many words, whose bytes are gone through together, the first of all, then the second: (words, 1 + stems)."""
    out = np.full((len(words), 1 + len(STEMS)), -1, np.int32)
    plain = [w.lower().strip(_MARKS).encode() for w in words]
    size = np.fromiter(map(len, plain), np.int64, len(plain))
    for i in np.flatnonzero(size > LETTERS):
        out[i] = features(words[i])
    at = np.flatnonzero(size <= LETTERS)
    at = at[np.argsort(-size[at], kind="stable")]
    size = size[at]
    letters = np.frombuffer(b"".join([plain[i] for i in at]), np.uint8)
    start = np.cumsum(size) - size
    first = (letters & 0xC0) != 0x80  # byte of a character
    before = np.cumsum(first) - first
    before -= np.repeat(before[start[size > 0]], size[size > 0])  # characters of the word before each byte
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    step = lambda c, letter: _CRC[(c ^ letter) & _LOW] ^ (c >> np.uint32(8))
    for k in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -k, "left"))  # words with more than k bytes come first
        here = start[:n] + k
        if k >= STEMS[0]:
            for j, stem in enumerate(STEMS):
                ended = np.flatnonzero(first[here] & (before[here] == stem))
                out[at[ended], 1 + j] = ~step(crc[ended], np.uint32(ord(" "))) % np.uint32(BUCKETS)
        crc[:n] = step(crc[:n], letters[here].astype(np.uint32))
    out[at, 0] = ~crc % np.uint32(BUCKETS)
    return out


def buckets(text: str | None, cache: BoundedCache) -> np.ndarray:
    """The buckets of a text's words, in order: (words, 1 + stems)."""
    words = text.split() if text else ()
    return np.array([cache[w] for w in words], np.int32).reshape(len(words), 1 + len(STEMS))


@dataclass
class Model:
    """``rows[bucket]`` is a bucket's row in the tables below; row 0, of zeros, is that of rare ones and of bucket -1."""

    rows: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]  # one (width, DIM, FILTERS) array per width
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: list[str]
    language_rows: np.ndarray  # log-likelihood of a row in each language
    thresholds: np.ndarray  # logit that maps to a score of 0.5, by language

    def taps(self, sets: np.ndarray | None = None) -> np.ndarray:
        """What each row, or set of rows, adds to each filter at each of its places: (rows or sets, sum of widths, FILTERS)."""
        embedding = self.embedding if sets is None else self.embedding[sets].sum(1)
        return np.stack([embedding @ f[t] for f in self.filters for t in range(len(f))], 1).astype(np.float32)


def _keys(sets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set of rows."""
    factors = np.random.default_rng(1).integers(1 << 40, 1 << 62, sets.shape[1], np.uint64)
    keys = np.zeros(len(sets), np.uint64)
    for k, factor in enumerate(factors):  # a column at a time, as all in 64 bits would take four times their room
        keys += sets[:, k].astype(np.uint64) * factor
    return keys


def _numbered(rows: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct sets of rows that the words of all texts have, that of zeros first, and each text as numbers of sets."""
    whole = np.concatenate([np.zeros((1, 1 + len(STEMS)), np.int32), *rows])
    _, first, number = np.unique(_keys(whole), return_index=True, return_inverse=True)
    return whole[first], np.split(number[1:].astype(np.int32), np.cumsum([len(r) for r in rows])[:-1])


class Words:
    """Texts as numbers of the sets of rows that their words have, with what each set adds to the filters and languages.

    Stems of one word contain each other, so there are about as many sets as there are rows, however many words are met.
    """

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        sets = np.zeros((1, 1 + len(STEMS)), np.int32)
        self.keys, self.number = _keys(sets), np.zeros(1, np.int32)  # of all sets met, in the order of their keys
        self.added = self._of(sets)

    def _of(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.model.taps(sets), self.model.language_rows[sets].sum(1)

    def _learn(self, words: list[str]) -> None:
        """Words that aren't known, with their sets."""
        rows = self.model.rows[features_of(words)]
        key, first, inverse = np.unique(_keys(rows), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        new = self.keys[np.minimum(at, len(self.keys) - 1)] != key
        number = np.empty(len(key), np.int32)
        number[~new] = self.number[at[~new]]
        number[new] = len(self.number) + np.arange(new.sum())
        self.keys, self.number = np.insert(self.keys, at[new], key[new]), np.insert(self.number, at[new], number[new])
        if new.any():
            self.added = tuple(np.concatenate(pair) for pair in zip(self.added, self._of(rows[first[new]]), strict=True))
        self.known.update(zip(words, number[inverse].tolist(), strict=True))

    def _numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        met = set().union(*texts)
        new = met.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known, new = {}, met
        if new:
            self._learn(list(new))
        return [np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)) for words in texts]

    def read(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The numbers of each text, some READ words at a time; ``added`` holds all of them afterwards."""
        numbers, some, size = [], [], 0
        for t in texts:
            some.append(t.split() if t else [])
            size += len(some[-1])
            if size >= READ:
                numbers += self._numbers(some)
                some, size = [], 0
        return numbers + self._numbers(some)


def _windows(added: np.ndarray) -> np.ndarray:
    """Filter values at every place, from the taps of each word; the text ends in WIDTHS[-1] - 1 empty words."""
    n = len(added) - WIDTHS[-1] + 1
    at, values = 0, []
    for w in WIDTHS:
        values.append(sum(added[t : t + n, at + t] for t in range(w)))
        at += w
    return np.concatenate(values, 1)


def _pooled(rows: list[np.ndarray], taps: np.ndarray) -> np.ndarray:
    """The largest value of each filter in each text; an empty text has that of one empty word."""
    out = np.empty((len(rows), len(WIDTHS) * FILTERS), np.float32)
    gap = np.zeros(WIDTHS[-1] - 1, np.int32)
    i = 0
    while i < len(rows):
        j, size = i, 0
        while j < len(rows) and (j == i or size + len(rows[j]) <= SLICE):
            size += len(rows[j]) + len(gap) + 1
            j += 1
        if j == i + 1 and len(rows[i]) > SLICE:  # one very long text, by overlapping parts
            r = rows[i]
            parts = [_pooled([r[k : k + SLICE]], taps) for k in range(0, len(r), SLICE - len(gap))]
            out[i] = np.concatenate(parts).max(0)
        else:
            flat, starts, at = [], [], 0
            for r in rows[i:j]:
                r = r if len(r) else gap[:1]
                flat += [r, gap]
                starts.append(at)
                at += len(r) + len(gap)
            out[i:j] = np.maximum.reduceat(_windows(taps[np.concatenate(flat)]), starts, 0)
        i = j
    return out


def _logits(model: Model, pooled: np.ndarray) -> np.ndarray:
    return np.maximum(pooled + model.bias, 0) @ model.out + model.out_bias


def _languages(numbers: list[np.ndarray], likelihood: np.ndarray) -> np.ndarray:
    """Index of the likeliest language of each text, from the log-likelihoods that sets of rows have."""
    return np.array([int(np.argmax(likelihood[r].sum(0))) for r in numbers], np.int64)


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 0) -> Model:
    """Fit on documents given as buckets of words, thresholds included: a part kept for those alone would hold too few toxic ones of a language."""
    rng = np.random.default_rng(seed)
    spread = np.zeros(BUCKETS, np.int32)
    positive = np.zeros(BUCKETS, np.int32)
    distinct = [np.unique(t[t >= 0]) for t in texts]
    for u, y in zip(distinct, labels, strict=True):
        spread[u] += 1
        positive[u] += y
    kept = np.flatnonzero(spread >= LEAST_DOCUMENTS)
    y = np.asarray(labels, np.float32)
    names = sorted({x for x in langs if x is not None}) or ["und"]
    spoken = np.zeros((BUCKETS, len(names)), np.int32)
    for u, k in zip(distinct, langs, strict=True):
        if k is not None:
            spoken[u, names.index(k)] += 1
    model = _begun(kept, positive[kept], spread[kept], spoken[kept], float(y.sum()), float((1 - y).sum()), names, rng)
    if texts:
        sets, numbers = _numbered([model.rows[t] for t in texts])
        _descend(model, sets, numbers, y, rng)
        logits = _logits(model, _pooled(numbers, model.taps(sets)))
        told = _languages(numbers, model.language_rows[sets].sum(1))
    else:
        logits, told = np.zeros(0), np.zeros(0, np.int64)
    model.thresholds[:] = _thresholds(logits, y, told, len(names))
    return model


def _begun(kept: np.ndarray, positive: np.ndarray, spread: np.ndarray, spoken: np.ndarray, toxic: float, clean: float, names: list[str], rng: np.random.Generator) -> Model:
    """The model before it descends, from counts: the documents that hold each ``kept`` bucket, toxic ones, all, and those of each language."""
    rows = np.zeros(BUCKETS + 1, np.int32)
    rows[kept] = np.arange(1, len(kept) + 1)
    n1, n0 = max(1.0, toxic), max(1.0, clean)
    # the first component starts as the bucket's log-odds, where they are beyond chance
    odds = np.log((positive + 1) / (n1 + 2)) - np.log((spread - positive + 1) / (n0 + 2))
    rate = n1 / (n1 + n0)
    deviation = (positive - spread * rate) / np.sqrt(spread * rate * (1 - rate) + 1e-9)
    embedding = rng.normal(0, 0.05, (len(kept) + 1, DIM)).astype(np.float32)
    embedding[1:, 0] = np.clip(odds, -3, 3) * (np.abs(deviation) > LEAST_DEVIATION)
    embedding[0] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, :2] = 1.0
    seen = np.ones((len(kept) + 1, len(names)))
    seen[1:] += spoken
    likelihood = np.log(seen / seen[1:].sum(0) if len(kept) else seen).astype(np.float32)
    likelihood[0] = 0
    model = Model(rows, embedding, filters, np.full(len(WIDTHS) * FILTERS, -0.1, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0, names, likelihood, np.zeros(len(names)))
    model.out[:] = rng.uniform(0.1, 0.3, len(model.out))
    return model


def _thresholds(logits: np.ndarray, y: np.ndarray, spoken: np.ndarray, languages: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Each language's cut; where none pays, for lack of toxic documents, that of all documents; where that doesn't either: above all seen."""
    counts = np.ones(len(y), np.int64) if counts is None else counts
    shared = _threshold(logits, y, counts)
    if shared is None:
        shared = float(logits.max(initial=0.0) + 2.0)
    own = [_threshold(logits[spoken == k], y[spoken == k], counts[spoken == k]) for k in range(languages)]
    return np.array([shared if cut is None else cut for cut in own])


def _threshold(logits: np.ndarray, y: np.ndarray, counts: np.ndarray) -> float | None:
    """The cut with the most toxic documents above it, less twice the clean ones; none if no cut pays. ``counts`` documents have each logit."""
    order = np.argsort(-logits, kind="stable")
    gain = np.cumsum(np.where(y[order] > 0, 1, -2) * counts[order])
    s = logits[order]
    ends = np.flatnonzero(np.append(s[:-1] > s[1:], True)) if len(s) else np.zeros(0, int)
    if not len(ends) or gain[ends].max() <= 0:
        return None
    k = int(ends[np.argmax(gain[ends])])
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1.0)


def _descend(model: Model, sets: np.ndarray, texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS, share: float | None = None) -> None:
    """Adam on the logistic loss; only the places of the maxima carry a gradient. ``share`` of all documents are toxic, by default as many as here."""
    share = float(y.mean()) if share is None and len(y) else share
    if not len(texts) or not 0 < share < 1:
        return
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    gap = np.zeros(WIDTHS[-1] - 1, np.int32)
    params = [model.embedding, *model.filters, model.bias, model.out, bias := np.full(1, model.out_bias, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            chosen = order[b : b + BATCH]
            flat, starts, ends, at = [], [], [], 0
            for i in chosen:
                r = texts[i] if len(texts[i]) else gap[:1]
                flat += [r, gap]
                starts.append(at)
                ends.append(at := at + len(r) + len(gap))
            used, words = np.unique(np.concatenate(flat), return_inverse=True)
            seen = np.where(rng.random(len(model.embedding)) < HIDDEN, 0, np.arange(len(model.embedding), dtype=np.int32))[sets[used]]
            values = _windows(model.taps(seen)[words]) + model.bias
            best = np.maximum.reduceat(values, starts, 0)
            place = np.stack([s + np.argmax(values[s : max(s + 1, e - len(gap))], 0) for s, e in zip(starts, ends, strict=True)])
            hidden = np.maximum(best, 0)
            logit = hidden @ model.out + bias
            slope = (1 / (1 + np.exp(-logit)) - y[chosen]) * weight[chosen] / len(chosen)
            grads = [np.zeros_like(p) for p in params]
            grads[-1][:] = slope.sum()
            grads[-2][:] = hidden.T @ slope
            back = slope[:, None] * model.out * (best > 0)
            grads[-3][:] = back.sum(0)
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                for t in range(w):
                    ids = words[np.minimum(place[:, k * FILTERS : (k + 1) * FILTERS] + t, len(words) - 1)]
                    grads[1 + k][t] = np.einsum("bfd,bf->df", model.embedding[seen[ids]].sum(2), g)
                    np.add.at(grads[0], seen[ids], (g[:, :, None] * f[t].T[None])[:, :, None])
            grads[0][0] = 0
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g += DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            model.embedding[0] = 0
    model.out_bias = float(bias[0])


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label, order): one row for each labelled id; toxic counts."""
    return (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .withColumn("order", F.xxhash64("id"))
    )


def _hashed(rows: DataFrame) -> DataFrame:
    """(order, id, label, lang, words, n) of ``rows``, which have a text: the buckets of its words, packed, and their number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=4):
            place = defaultdict(count().__next__)  # the slice's different words
            numbers = [np.fromiter(map(place.__getitem__, t.split() if t else ()), np.int64) for t in texts_of(batch.column(4))]
            table = features_of(list(place))
            found = [table[k] for k in numbers]
            raw, n = [zstandard.compress(b.tobytes()) for b in found], [len(b) for b in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(raw, pa.binary()), pa.array(n, pa.int64())], ["order", "id", "label", "lang", "words", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    return small_batches(rows.select("order", "id", "label", "lang", "text")).mapInArrow(frugal(hashed), f"order long, id {kind}, label int, lang string, words binary, n long")


def _shown(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``texts`` (id, ...) whose id is in ``known``, and few others: told by a bounded map of bits, so no text is shuffled for it."""
    bits = min(MAP_BITS, max(1, known.count()) * ID_BITS)
    place = lambda df: df.withColumn("__h", F.pmod(F.xxhash64("id"), F.lit(bits)))
    at, bit = F.bitmap_bucket_number("__h"), F.bitmap_bit_position("__h")
    maps = place(known).groupBy(at.alias("__at")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    met = place(texts).withColumns({"__at": at, "__bit": bit}).join(F.broadcast(maps), "__at")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.floor(byte / F.pow(F.lit(2), F.col("__bit") % 8)) % 2 == 1).select(texts.columns)


def _unpacked(words: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(words), np.int32).reshape(-1, 1 + len(STEMS))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """Fit in the driver, on at most ``SAMPLE_PER_LABEL`` labelled rows of either label; unlabelled rows do not count. :func:`fit_all` fits on all.

    Rows with a null label or id are left out. With one label only, or none, the score stays below 0.5 throughout.
    """
    known = _known(labels, id_col, label_col)
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    span = 2.0**63
    near = F.when(F.col("label") == 1, min(1.0, 3 * SAMPLE_PER_LABEL / sizes.get(1, 1)) * span).otherwise(min(1.0, 3 * SAMPLE_PER_LABEL / sizes.get(0, 1)) * span)
    few = known.where(F.abs(F.col("order").cast("double")) <= near)
    first = lambda y: few.where(F.col("label") == y).orderBy("order", "id").limit(SAMPLE_PER_LABEL)
    sample = first(0).unionByName(first(1))  # a bounded number of ids, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    hashes = _hashed(texts.join(F.broadcast(sample), "id"))
    held = stash(hashes.withColumn("row", F.monotonically_increasing_id()), "sample")  # at most 2 * SAMPLE_PER_LABEL rows
    taken = fitting([(r.row, r.n) for r in held.orderBy("order", "id", "n").select("row", "n").collect()], SAMPLE_WORDS)
    found = sorted(held.where(F.col("row").isin(taken)).collect(), key=lambda r: (r.order, r.words))
    discard(held)
    model = train([_unpacked(r.words) for r in found], np.array([r.label for r in found], np.int32), [r.lang for r in found])
    del found
    give_back()
    return model


def fitting(rows: list[tuple[int, int]], most: int) -> list[int]:
    """Of (row, words), in order, those whose words fit beside the ones before them; one that doesn't is passed over alone."""
    taken, words = [], 0
    for row, n in rows:
        if words + n <= most:
            taken.append(row)
            words += n
    return taken


def fit_all(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """Fit on all labelled rows. Where they are within the bounds of :func:`fit`, that is its model; else its weights are those that all rows go on from.

    Counts of buckets and languages are sums over all rows. Weights take ``PASSES`` passes: tasks descend from the same weights,
    each over a shard of the rows, and what they come to is averaged, an embedding by how often its bucket was met.
    Thresholds are found on all rows, counted by logit. What the driver holds is bounded by the number of buckets.
    """
    columns = id_col, text_col, lang_col, label_col
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = _known(labels, id_col, label_col)
    held = stash(_hashed(_shown(texts, known).join(known.hint("merge"), "id")), "labelled")
    sizes = {r.label: r for r in held.groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("words")).collect()}
    words = sum(r.words for r in sizes.values())
    if words <= SAMPLE_WORDS and all(r.rows <= SAMPLE_PER_LABEL for r in sizes.values()):
        discard(held)
        return fit(docs, labels, *columns)
    start = fit(docs, labels, *columns)
    toxic, clean = (sizes[y].rows if y in sizes else 0 for y in (1, 0))
    dealt = held.coalesce(-(-words // SHARD_WORDS) or 1)  # rows lie by a hash of the id
    model = _carried(_counted(dealt, toxic, clean, words), start)
    for k in range(PASSES if toxic and clean else 0):
        model = _averaged(held, model, k, toxic / (toxic + clean), words)
    give_back()
    logits = _judged(held, model).groupBy("spoken", "cell", "label").agg(F.count("*").alias("n")).toArrow().to_pydict()
    model.thresholds[:] = _thresholds((np.array(logits["cell"]) + 0.5) / GRID, np.array(logits["label"]), np.array(logits["spoken"]), len(model.languages), np.array(logits["n"]))
    discard(held)
    return model


def _counted(held: DataFrame, toxic: int, clean: int, words: int = 0) -> Model:
    """The model that the counts of all rows of ``held`` begin, with the buckets that enough of them have."""
    names = sorted(r.lang for r in held.where("lang is not null").select("lang").distinct().collect()) or ["und"]
    ranges = min(BUCKETS >> 6, max(LEAST_RANGES, words // SHARD_WORDS // SHARDS_A_RANGE))
    counts = held.select("label", "lang", "words").mapInArrow(frugal(_tally(names, ranges)), "range int, data binary")
    columns = ["bucket", "spread", "positive", *(f"l{k}" for k in range(len(names)))]
    sums = counts.repartition(ranges, "range").groupBy("range").applyInArrow(_summed(names, ranges), ", ".join(f"{c} long" for c in columns))
    table = sums.toArrow().sort_by("bucket")
    column = lambda c: table.column(c).to_numpy()
    return _begun(column("bucket"), column("positive"), column("spread"), np.stack([column(f"l{k}") for k in range(len(names))], 1), toxic, clean, names, np.random.default_rng(0))


def _tally(names: list[str], ranges: int):
    """Task function: (label, lang, words) -> (range, data): how many documents of each kind, a label and language, have each bucket.

    Counts go packed, a row for each range of buckets.
    """
    place = {name: k for k, name in enumerate(names)} | {None: len(names)}
    edges = -(-np.arange(ranges + 1) * BUCKETS // ranges)

    def sent(sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        kind = np.repeat(np.array(list(sums), np.uint32), [len(b) for b, _ in sums.values()])
        bucket, n = (np.concatenate(x).astype(np.uint32) for x in zip(*sums.values(), strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket, kind, n = bucket[order], kind[order], n[order]
        cut = np.searchsorted(bucket, edges)
        some = np.flatnonzero(np.diff(cut))
        data = [zstandard.compress(b"".join(planes(x[cut[r] : cut[r + 1]]) for x in (bucket, kind, n)), 1) for r in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], ["range", "data"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, sums, size = defaultdict(list), {}, 0

        def count_met() -> None:
            for kind, found in met.items():
                n = np.bincount(np.concatenate(found), minlength=BUCKETS)
                if kind in sums:
                    n[sums[kind][0]] += sums[kind][1]
                sums[kind] = (at := np.flatnonzero(n).astype(np.uint32), n[at].astype(np.uint32))
            met.clear()

        for batch in batches:
            for label, lang, raw in zip(batch.column("label").to_pylist(), batch.column("lang").to_pylist(), batch.column("words"), strict=True):
                found = np.unique(_unpacked(raw.as_py()))
                met[2 * place[lang] + label].append(found[np.searchsorted(found, 0) :])
                size += len(found)
                if size >= GATHERED:
                    count_met()
                    size = 0
                    if sum(len(b) for b, _ in sums.values()) >= COUNTED:
                        yield from sent(sums)
                        sums.clear()
        if met:
            count_met()
        if sums:
            yield from sent(sums)

    return tally


def _summed(names: list[str], ranges: int):
    """Group function: the packed counts of a range -> (bucket, spread, positive, one count for each language) of buckets that enough documents have."""
    kinds = 2 * (len(names) + 1)

    def summed(table: pa.Table) -> pa.Table:
        low, high = (-(-(table.column("range")[0].as_py() + k) * BUCKETS // ranges) for k in (0, 1))
        n = np.zeros((kinds, high - low), np.int64)
        for data in table.column("data"):
            bucket, kind, more = _columns(zstandard.decompress(data.as_py()), 3)
            n[kind, bucket.astype(np.int64) - low] += more  # a task names a bucket of a kind once in a row
        spread = n.sum(0)
        at = np.flatnonzero(spread >= LEAST_DOCUMENTS)
        found = [at + low, spread[at], n[1::2, at].sum(0), *(n[2 * k : 2 * k + 2, at].sum(0) for k in range(len(names)))]
        give_back()
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["bucket", "spread", "positive", *(f"l{k}" for k in range(len(names)))])

    return summed


def _columns(raw: bytes, columns: int) -> list[np.ndarray]:
    """So many columns of unsigned 32-bit integers, each as byte planes."""
    size = len(raw) // columns
    return [unplanes(raw[k * size : (k + 1) * size], np.uint32) for k in range(columns)]


def _carried(model: Model, start: Model) -> Model:
    """``model`` with the weights of ``start``; buckets that it didn't have keep theirs."""
    kept = np.flatnonzero(model.rows)
    old = start.rows[kept]
    model.embedding[model.rows[kept[old > 0]]] = start.embedding[old[old > 0]]
    return replace(model, filters=start.filters, bias=start.bias, out=start.out, out_bias=start.out_bias)


def _averaged(held: DataFrame, model: Model, number: int, share: float, words: int = 0) -> Model:
    """``model`` after each shard of ``held``, as much of a partition as has ``SHARD_WORDS`` words, has descended from it once, averaged.

    A task adds up what its shards come to, so what is shuffled grows with the tasks, each of ``SHARDS_A_TASK`` shards where there are many.
    """
    shards = -(-words // SHARD_WORDS) or 1
    dealt = held.coalesce(min(shards, max(LEAST_TASKS, shards // SHARDS_A_TASK)))
    ranges = max(LEAST_RANGES, shards // SHARDS_A_RANGE)
    known = held.sparkSession.sparkContext.broadcast(model)
    found = dealt.select("order", "label", "words", "n").mapInArrow(frugal(_descended(known, number, share, ranges)), "range int, data binary")
    columns = "row int, " + ", ".join(f"v{k} float" for k in range(DIM))
    table = found.repartition(ranges, "range").groupBy("range").applyInArrow(_mean(len(model.embedding) + len(_whole(model)), ranges), columns).toArrow()
    known.destroy()
    row, values = table.column("row").to_numpy(), np.stack([table.column(f"v{k}").to_numpy() for k in range(DIM)], 1)
    embedding = model.embedding.copy()
    own = row < len(embedding)
    embedding[row[own]] = values[own]
    whole = values[~own][np.argsort(row[~own])].ravel()
    parts = np.split(whole, np.cumsum([*(f.size for f in model.filters), model.bias.size, model.out.size]))
    filters = [x.reshape(f.shape) for x, f in zip(parts, model.filters, strict=False)]
    return replace(model, embedding=embedding, filters=filters, bias=parts[-3], out=parts[-2], out_bias=float(parts[-1][0]))


def _whole(model: Model) -> np.ndarray:
    """The weights that all texts share, as rows like those of the embedding."""
    whole = np.concatenate([*(f.ravel() for f in model.filters), model.bias, model.out, [model.out_bias]])
    return np.pad(whole, (0, -len(whole) % DIM)).astype(np.float64).reshape(-1, DIM)


def _descended(known: Broadcast, number: int, share: float, ranges: int):
    """Task function: (order, label, words, n) -> (range, data): rows of weights that its shards met, how often, and their means over the shards.

    They go packed, a row for each range of rows. Weights that all texts share stand beyond the embedding.
    """

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
        shard, words = [], 0
        for batch in batches:
            for order, label, raw, n in zip(*(batch.column(c).to_pylist() for c in ("order", "label", "words", "n")), strict=True):
                if shard and words + n > SHARD_WORDS:
                    yield sorted(shard)
                    shard, words = [], 0
                shard.append((order, label, raw))
                words += n
        if shard:
            yield sorted(shard)

    def descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        sums, times = None, None
        for shard in gathered(batches):
            y = np.array([r[1] for r in shard], np.float32)
            sets, numbers = _numbered([m.rows[_unpacked(raw)] for _, _, raw in shard])
            used, sets = np.unique(sets, return_inverse=True)
            sets = sets.astype(np.int32).reshape(-1, 1 + len(STEMS))
            mine = replace(m, embedding=m.embedding[used], filters=[f.copy() for f in m.filters], bias=m.bias.copy(), out=m.out.copy())
            _descend(mine, sets, numbers, y, np.random.default_rng([number, len(y)]), 1, share)
            n = np.bincount(sets.ravel(), np.repeat(np.bincount(np.concatenate(numbers), minlength=len(sets)), sets.shape[1]), len(used))
            whole = _whole(mine)
            if sums is None:
                sums = np.zeros((len(m.embedding) + len(whole), DIM))
                times = np.zeros(len(sums))
            sums[used[1:]] += n[1:, None] * mine.embedding[1:]
            times[used[1:]] += n[1:]
            sums[len(m.embedding) :] += len(y) * whole
            times[len(m.embedding) :] += len(y)
        if sums is None:
            return
        row = np.flatnonzero(times)
        cut = np.searchsorted(row, np.arange(ranges + 1) * len(sums) // ranges)
        some = np.flatnonzero(np.diff(cut))
        data = []
        for r in some:
            at = row[cut[r] : cut[r + 1]]
            means = (sums[at] / times[at, None]).astype(np.float32)
            columns = at.astype(np.uint32), *(x.view(np.uint32) for x in (times[at].astype(np.float32), *np.ascontiguousarray(means.T)))
            data.append(zstandard.compress(b"".join(map(planes, columns)), 1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], ["range", "data"])

    return descended


def _mean(rows: int, ranges: int):
    """Group function: the packed weights of a range of so many ``rows`` in all -> (row, its value in each dimension), weighted by how often each task met it."""

    def mean(table: pa.Table) -> pa.Table:
        low, high = ((table.column("range")[0].as_py() + k) * rows // ranges for k in (0, 1))
        times, sums = np.zeros(high - low), np.zeros((DIM, high - low))
        for data in table.column("data"):
            row, n, *values = _columns(zstandard.decompress(data.as_py()), 2 + DIM)
            at, n = row.astype(np.int64) - low, n.view(np.float32).astype(np.float64)
            times[at] += n  # a task names a row once
            for total, x in zip(sums, values, strict=True):
                total[at] += n * x.view(np.float32)
        met = np.flatnonzero(times)
        means = (sums[:, met] / times[met]).astype(np.float32)
        give_back()
        return pa.table([pa.array(met + low, pa.int32()), *map(pa.array, means)], names=["row", *(f"v{k}" for k in range(DIM))])

    return mean


def _judged(held: DataFrame, model: Model) -> DataFrame:
    """(spoken, cell, label) of each row of ``held``: its language as its words tell it, its logit in parts of ``GRID``, its label."""
    known = held.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in slices(batches, 256):
            sets, numbers = _numbered([m.rows[_unpacked(raw)] for raw in batch.column("words").to_pylist()])
            logits = np.clip(_logits(m, _pooled(numbers, m.taps(sets))), -FARTHEST, FARTHEST)
            spoken = _languages(numbers, m.language_rows[sets].sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(spoken), pa.array(np.floor(logits * GRID).astype(np.int64)), batch.column("label")], ["spoken", "cell", "label"])

    return held.select("label", "words").mapInArrow(frugal(judged), "spoken long, cell long, label int")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with toxicity, from 0 to 1 (replacing a column so named); 0.5 is the threshold of its language.

    Null and empty texts score as one empty word. Every text goes through the filters whole.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxicity")
    names = docs.columns
    at = names.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        words = Words(m)
        for batch in slices(batches, column=at):
            numbers = words.read(texts_of(batch.column(at)))
            taps, likelihood = words.added
            logits = _logits(m, _pooled(numbers, taps)) if numbers else np.zeros(0)
            above = np.clip(logits - m.thresholds[_languages(numbers, likelihood)], -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-above)), pa.float64())], [*names, "toxicity"])

    return small_batches(docs).mapInArrow(frugal(scored), StructType([*docs.schema.fields]).add("toxicity", "double"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted): fit on labelled rows that are not held out, score all rows of ``docs``.

    Null and empty texts score as one empty word. Very long texts are scored whole. Repeated rows get equal scores; of
    labels that contradict each other, toxic counts. Without labels of both kinds nothing is predicted toxic. An empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    shown = crc_bucket(id_col) != 0
    model = fit_all(docs.where(shown), labels.where(shown), id_col, text_col, lang_col, label_col)
    chosen = docs.select(F.col(id_col), (crc_bucket(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return score(chosen, model).select(
        id_col, "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
