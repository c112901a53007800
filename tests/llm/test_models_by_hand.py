"""The classifiers and the alignment of recordings against plain loops, and tables whose columns clash."""

import zlib

import numpy as np
import pytest
import zstandard

from wayfold.llm import audio, language, toxicity

SF = "/root/testdata/sf0.001"


def test_every_prediction_by_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    fit = language.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    assert fit and all(len(raw) <= language.DICTIONARY for _, raw in fit)
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    for r in rows:
        assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not r.text or not any(c.isalpha() for c in r.text):
            assert found[r.doc_id].lang_pred == "und"
            continue
        words = "".join(c if c.isalpha() else " " for c in r.text.lower().replace("_", " "))
        raw = language.letters(r.text)
        if r.text.isascii():
            assert raw.split() == words.encode().split()
        best = None
        for name, sample in fit:
            tool = zstandard.ZstdCompressor(level=language.LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(sample.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            size = sum(len(tool.compress(raw[i : i + language.BLOCK])) for i in range(0, len(raw), language.BLOCK))
            if best is None or size < best[0]:
                best = size, name
        # the dictionaries are prepared once for many texts, which may cost a byte here and there
        if found[r.doc_id].accepted:
            assert found[r.doc_id].lang_pred == best[1]


def test_dictionaries_see_the_whole_text():
    raw = b"".join(bytes([97 + k]) * 1000 for k in range(20))
    assert {c for c in language.spread(raw)} >= {97, 116} and len(language.spread(raw)) == language.SLICE
    assert language.spread(b"abc") == b"abc"


def test_scores_by_a_plain_convolution(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.fit(docs, labels)
    found = {r.doc_id: r.toxicity for r in toxicity.score(docs, m).select("doc_id", "toxicity").collect()}
    for r in docs.collect()[:60]:
        words = [toxicity.features(w) for w in (r.text or "").split()] or [None]
        rows = [[m.rows[b] if b >= 0 else 0 for b in w] if w else [0] for w in words]
        vectors = [m.embedding[x].sum(0) for x in rows] + [np.zeros(toxicity.DIM)] * (toxicity.WIDTHS[-1] - 1)
        pooled = []
        for width, f in zip(toxicity.WIDTHS, m.filters, strict=True):
            pooled.append(np.max([sum(vectors[i + t] @ f[t] for t in range(width)) for i in range(len(words))], 0))
        hidden = np.maximum(np.concatenate(pooled) + m.bias, 0)
        spoken = int(np.argmax(sum(m.language_rows[x].sum(0) for x in rows)))
        logit = hidden @ m.out + m.out_bias - m.thresholds[spoken]
        assert found[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -30, 30))), abs=1e-3)


def test_alignment_by_plain_comparison(spark):
    rng = np.random.default_rng(12)
    base = [np.round(rng.normal(0, 0.4, 16), 2) for _ in range(6)]
    vectors = [(k, [float(x) for x in base[k % 6] + (k % 5 == 4) * rng.normal(0, 0.02, 16)], 0) for k in range(24)] + [(100, None, 0), (101, [], 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in audio.aligned(df, every=4).collect()}
    prints = {r.id: np.array(r.items, np.uint32) for r in audio.fingerprints(audio.rendered(df), "id", "samples").collect()}
    same = {}
    for i, p in prints.items():
        same.setdefault(p.tobytes(), []).append(i)
    for i, p in prints.items():
        hits = {}
        for q in (q for q in prints if q % 4 == 0 and len(prints[q])):
            a, best = prints[q], None
            if not len(p):
                continue
            for o in range(-len(p), len(a)):
                pairs = [(a[k + o], p[k]) for k in range(len(p)) if 0 <= k + o < len(a)]
                told = [(x, y) for x, y in pairs if not x == y == audio.SILENCE]
                wrong = sum(int(x ^ y).bit_count() for x, y in told)
                if len(pairs) >= audio.LEAST_ITEMS and len(told) >= audio.LEAST_VOTES and wrong <= audio.MOST_ERRORS * 32 * len(told):
                    gain = 32 * len(told) - 2 * wrong, -abs(o), o
                    best = max(best, gain) if best else gain
            if best or p.tobytes() == a.tobytes():
                hits[a.tobytes()] = min(hits.get(a.tobytes(), q), q)
        assert found[i].n_queries == len(hits), i
        assert found[i].first_query == (min(hits.values()) if hits else None)
    assert audio.aligned(df.where("vec_id < 0")).count() == 0


def test_columns_that_clash(spark):
    rows = [(k, "der und die ist nicht mit" if k % 2 else "the and that is not with it", "de" if k % 2 else "en", "x", 9.0, False, 1, "w") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean, predicted int, words string")
    got = language.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"] and {r.lang_pred for r in got.collect()} == {"de", "en"}
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    clashing = df.withColumnRenamed("words", "toxicity").withColumnRenamed("lang_pred", "label").withColumnRenamed("score", "order")
    scored = toxicity.score(clashing, toxicity.fit(clashing, labels))
    assert sorted(scored.columns) == sorted(clashing.columns) and dict(scored.dtypes)["toxicity"] == "double"
    assert {r.predicted for r in toxicity.classify(clashing, labels).collect()} <= {0, 1}
    assert toxicity.classify(clashing.where("doc_id < 0"), labels.where("doc_id < 0")).count() == 0
