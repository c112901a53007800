import pytest

from wayfold.llm import jaccard, suffix_dedup


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    """Small tables don't need the buckets of large ones."""
    monkeypatch.setattr(jaccard, "LEAST_BUCKETS", 3)
    monkeypatch.setattr(suffix_dedup, "LEAST_BUCKETS", 3)


@pytest.fixture
def docs(spark):
    """rows -> documents with an extra column whose name operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", 0, "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, bucket string")

    return make
