"""The pipeline's stages, each against what its operator says of single documents, and its odd inputs."""

import pytest

import corpus_pipeline
from wayfold.llm import language, packing, toxicity
from wayfold.llm.common import crc_bucket, read, stash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        made = stash(stage(spark, docs, SF), "stage")
        out.append((docs, made))
        docs = made
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_toxic_documents_go(spark, stages):
    docs, left = stages[0]
    m = toxicity.fit(docs, read(spark, SF, "labels").where(crc_bucket("doc_id") != 0))
    want = []
    for r in docs.collect():  # one document at a time
        words = toxicity.Words(m)
        numbers = words.read([r.text])
        taps, likelihood = words.added
        logit = toxicity._logits(m, toxicity._pooled(numbers, taps))[0] - m.thresholds[toxicity._languages(numbers, likelihood)[0]]
        want += [r.doc_id] * int(logit < 0)
    assert ids(left) == sorted(want) and left.columns == docs.columns


def test_unclear_languages_go(spark, stages):
    docs, left = stages[1]
    tool = language.Sizer(language.fit(docs.where(crc_bucket("doc_id") != 0)))
    assert ids(left) == sorted(r.doc_id for r in docs.collect() if tool.predict(r.text)[2])


def test_all_that_is_left_is_packed(spark, stages):
    docs, pieces = stages[4]
    lengths = {}
    places = {}
    for r in pieces.collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    from wayfold.llm import bpe

    assert lengths == {r.doc_id: len(bpe.encoder().library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_columns_and_empty_tables(spark, stages):
    docs = stages[2][1].drop("n_chars").withColumnRenamed("source", "row")
    left = corpus_pipeline.without_repeated_passages(spark, docs, SF)
    assert left.columns == docs.columns and left.count() == docs.count()
    empty = read(spark, SF, "documents").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
