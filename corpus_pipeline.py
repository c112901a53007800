"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's ``docs``. All but the
last return the columns that they got, in their order; ``doc_id``, ``text`` and ``lang`` must be among them.

Null and empty texts score as one empty word, are told no language and so go in the second stage. Repeated rows pass
the filters alike and stay; of rows that share an id, all stay or go with it in the third stage. An empty table gives an
empty result. Very long texts are treated whole, extra columns of any name are handed on up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import jaccard, language, packing, suffix_dedup, toxicity
from wayfold.llm.common import crc_bucket, read, stash


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below the threshold of their language; it learns from labelled rows that are not held out."""
    labels = read(spark, sf_dir, "labels").where(crc_bucket("doc_id") != 0)
    return toxicity.score(docs, toxicity.fit_all(docs.where(crc_bucket("doc_id") != 0), labels)).where("toxicity < 0.5").select(docs.columns)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by more than the narrowest margin; texts without a letter go."""
    known = language.fit(docs.where(crc_bucket("doc_id") != 0))
    return language.predict(docs, known).where("lang_accepted").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links join, the one with the smallest id."""
    others = jaccard.jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat a document with a smaller id."""
    left = suffix_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("language ID", with_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeated_passages),
    ("best-fit packing", packed),
]

#: SQL can express neither the classifiers nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
