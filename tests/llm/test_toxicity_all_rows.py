"""Rows beyond what the driver fits on count too."""

import numpy as np

from wayfold.llm import toxicity


def test_words_that_no_sampled_row_has_are_learnt(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_PER_LABEL", 12)
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 2000)
    foul = ["vile", "rude", "mean", "grim", "foul", "cruel", "nasty", "awful", "gross", "lousy"]
    rows = [(k, f"some plain words to read {k % 7} " + (foul[k // 4 % 10] if k % 4 == 0 else "kind") + " and more of them", "en") for k in range(1200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(1200)], "doc_id long, toxic int")
    model = toxicity.fit_all(docs(rows), labels)
    # twelve toxic rows can't show three documents of each of ten words
    assert all(model.rows[toxicity.features(w)[0]] > 0 for w in foul)
    found = {r.doc_id: r.predicted for r in toxicity.classify(docs(rows), labels).collect()}
    assert all(found[k] == int(k % 4 == 0) for k in range(1200))


def test_counts_of_all_rows(spark, docs, monkeypatch):
    rows = [(k, f"a{k % 3} b{k % 5}", ("en", "fr", None)[k % 3]) for k in range(90)]
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(90)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "_begun", lambda *given: seen.append(given))
    known = toxicity._known(labels, "doc_id", "toxic")
    held = toxicity._hashed(docs(rows).withColumnRenamed("doc_id", "id").join(known, "id"))
    toxicity._counted(held, 15, 75)
    kept, positive, spread, spoken, toxic, clean, names, _ = seen[0]
    texts = [(set(b for w in t.split() for b in toxicity.features(w) if b >= 0), k % 6 == 0, lang) for k, t, lang in rows]
    every = sorted(set().union(*(t for t, *_ in texts)))
    assert list(kept) == every and names == ["en", "fr"] and (toxic, clean) == (15, 75)
    assert list(spread) == [sum(b in t for t, *_ in texts) for b in every]
    assert list(positive) == [sum(b in t and y for t, y, _ in texts) for b in every]
    assert np.array_equal(spoken, [[sum(b in t and lang == k for t, _, lang in texts) for k in names] for b in every])
