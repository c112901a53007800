"""op9's counts go packed by ranges of buckets, and its caches keep words that come again."""

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from wayfold.llm import toxicity


def test_counts_go_packed_and_add_up(monkeypatch):
    monkeypatch.setattr(toxicity, "GATHERED", 20_000)
    monkeypatch.setattr(toxicity, "COUNTED", 60_000)
    rng = np.random.default_rng(1)
    rows, want = [], Counter()
    for k in range(300):
        words = (rng.zipf(1.2, (100, 5)) % toxicity.BUCKETS).astype(np.int32)
        words[rng.random(words.shape) < 0.1] = -1
        label, lang = int(rng.integers(2)), ["de", "en", None][k % 3]
        rows.append((label, lang, zstandard.compress(words.tobytes())))
        for b in set(words.ravel().tolist()) - {-1}:
            want.update([(b, "all"), (b, lang)] + [(b, "toxic")] * label)
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)]
    sent = pa.Table.from_batches([*toxicity._tally(["de", "en"], 64)(iter([pa.RecordBatch.from_arrays(columns, ["label", "lang", "words"])]))])
    found = sum(toxicity._columns(zstandard.decompress(x), 3)[0].size for x in sent.column("data").to_pylist())
    assert len(sent) <= 64 * 3 and sent.nbytes < 8 * found  # a row of two longs each before
    got = Counter()
    for r in set(sent.column("range").to_pylist()):
        summed = toxicity._summed(["de", "en"], 64)(sent.filter(pa.compute.equal(sent.column("range"), r)))
        for row in summed.to_pylist():
            got.update({(row["bucket"], name): row[c] for name, c in (("all", "spread"), ("toxic", "positive"), ("de", "l0"), ("en", "l1"))})
    enough = {b for (b, name), n in want.items() if name == "all" and n >= toxicity.LEAST_DOCUMENTS}
    assert +got == Counter({k: n for k, n in want.items() if k[0] in enough and k[1] is not None})


def test_words_are_hashed_together_as_one_by_one():
    words = ["", "a", "The", "the,", "!?", "stems", "Stem\u0131ng", "\u00bfcaf\u00e9?", "x" * 64, "y" * 65, "z" * 500, "\u03a3\u0391\u03a3", "two\x00words", *(f"w{k ** 3}" for k in range(500))]
    assert np.array_equal(toxicity.features_of(words), [toxicity.features(w) for w in words])
    assert toxicity.features_of([]).shape == (0, 1 + len(toxicity.STEMS))


def test_words_keep_their_numbers(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHED", 40)
    monkeypatch.setattr(toxicity, "READ", 7)
    rng = np.random.default_rng(2)
    texts = [None, "", *(" ".join(f"word{x} \u00e9{x}" for x in rng.zipf(1.3, 30) % 200) for _ in range(50))]
    kept = np.unique(toxicity.features_of([w for t in texts if t for w in t.split()])[:, 0])
    model = toxicity._begun(kept, np.ones(len(kept), int), np.full(len(kept), 3), np.ones((len(kept), 2), int), 9.0, 9.0, ["a", "b"], rng)
    words = toxicity.Words(model)
    for _ in range(2):
        for text, numbers in zip(texts, words.read(texts), strict=True):
            rows = model.rows[toxicity.features_of(text.split() if text else [])]
            assert np.array_equal(words.added[0][numbers], model.taps(rows)) and np.array_equal(words.added[1][numbers], model.language_rows[rows].sum(1))
    assert len(words.known) <= 40 + 14 and len(words.added[0]) == len(words.keys) == len(set(words.number.tolist()))
