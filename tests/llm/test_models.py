import numpy as np
import pytest

from wayfold.llm import language, registry, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return texts, labels


def test_languages_of_held_out_rows(spark, truth):
    rows = [r for r in registry.op6_language_id(spark, SF).collect() if r.held_out]
    assert len(rows) > 100
    assert np.mean([r.lang_pred == truth[0][r.doc_id].lang for r in rows]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_cases(docs):
    rows = [(k, f"the {k} and that of it is there with them all {k}", "en") for k in range(1, 30)] + [(k, f"der {k} und die ist nicht mit den ein {k}", "de") for k in range(30, 60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 !? 34", "en"), (103, "x", None), (104, "der und die ist nicht " * 3000, None), (104, "der und die ist nicht " * 3000, None)]
    found = {r.doc_id: r for r in language.identify(docs(rows)).collect()}
    assert [found[k].lang_pred for k in (100, 101, 102, 104)] == ["und", "und", "und", "de"]
    assert found[103].lang_pred in ("en", "de") and not found[100].accepted
    assert language.identify(docs([])).count() == 0
    assert {r.lang_pred for r in language.identify(docs([(1, "some text", None)])).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark, truth):
    rows = [r for r in registry.op9_toxicity(spark, SF).collect() if r.held_out]
    words = set("moron loser worthless clown disgusting idiot pathetic stupid trash scum".split())
    toxic = [r.predicted for r in rows if words & set((truth[0][r.doc_id].text or "").lower().replace(".", " ").replace(",", " ").split())]
    clean = [r.predicted for r in rows if truth[1].get(r.doc_id) == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.05


def test_toxicity_cases(spark, docs):
    rows = [(k, f"good day number {k} to all of you" + (" vile" if k % 3 == 0 else ""), "en") for k in range(240)]
    rows += [(1000, None, None), (1001, "", "en"), (1002, "word " * 30000 + "vile", None), (1002, "word " * 30000 + "vile", None), (1003, "VILE!", "xx")]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(240)] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    found = toxicity.classify(docs(rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r.predicted for r in found}
    assert by_id[1002] == 1 and by_id[1003] == 1 and by_id[1000] == 0 and by_id[1001] == 0
    assert all(by_id[k] == (k % 3 == 0) for k in range(240))
    none = toxicity.classify(docs(rows[:5]), labels.where("doc_id < 0")).collect()
    assert all(r.predicted == 0 for r in none)
    assert toxicity.classify(docs([]), labels.where("doc_id < 0")).count() == 0


def test_long_texts_in_parts():
    rng = np.random.default_rng(1)
    taps = rng.normal(size=(50, sum(toxicity.WIDTHS), toxicity.FILTERS)).astype(np.float32)
    text = rng.integers(0, 50, 1000).astype(np.int32)
    whole = toxicity._pooled([text], taps)
    slice_, toxicity.SLICE = toxicity.SLICE, 100
    try:
        assert np.allclose(toxicity._pooled([text], taps), whole)
        assert np.allclose(toxicity._pooled([text[:30], text, text[:0]], taps)[1], whole[0])
    finally:
        toxicity.SLICE = slice_
