"""Language identification by compression.

Each language has a zstandard dictionary of raw sample text. A text belongs to the language whose dictionary
encodes it in the fewest bytes; where the runner-up is nearly as good, the prediction is kept but not accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.llm.common import crc_bucket, frugal, slices, small_batches, texts_of

#: Sample of labelled rows that a dictionary is made of: rows a language, bytes of each, bytes in all.
SAMPLE_ROWS, SLICE, DICTIONARY = 192, 1024, 65_536
#: Texts are encoded block by block, so that the dictionary stays in reach throughout a long one.
BLOCK = 4096
LEVEL = 6
#: A prediction is accepted if its size is smaller than the runner-up's by this share at least.
MARGIN = 0.02
#: Steepness of the score in the share of bytes saved.
STEEP = 40.0
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words separated by single spaces: case, digits and marks say little about the language."""
    return (" " + _NOT_LETTERS.sub(" ", text.lower())).encode()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the most frequent language first.

    Learns from at most ``SAMPLE_ROWS`` different texts a language, chosen by a hash of the id, and of each from ``SLICE``
    bytes that lie evenly over the whole text. Rows without language, or without a letter in their text, are left out.
    """
    known = docs.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("order")
    ).where("lang is not null and text rlike '\\\\p{L}'")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    # a few times the rows needed, of each language alike, before any of them is ranked
    span = 2.0**63
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 8 * SAMPLE_ROWS / n) * span))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "copy"))
    near = known.where(F.abs(F.col("order").cast("double")) <= F.element_at(share, F.col("lang"))).withColumn("copy", F.xxhash64("text"))
    chosen = near.dropDuplicates(["lang", "copy"]).withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS).select("lang", "rank", "text")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=2):
            raw = [spread(letters(t)) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(raw, pa.binary())], ["lang", "rank", "raw"])

    rows = small_batches(chosen).mapInArrow(frugal(drawn), "lang string, rank int, raw binary").collect()
    sample: dict[str, bytes] = {k: b"" for k in sizes}
    for r in sorted(rows, key=lambda r: r.rank):
        sample[r.lang] += r.raw
    return [(k, sample[k][:DICTIONARY]) for k in sorted(sizes, key=lambda k: (-sizes[k], k))]


def spread(raw: bytes, pieces: int = 4) -> bytes:
    """``SLICE`` bytes in pieces that lie evenly over the whole of ``raw``; all of it if there are no more."""
    if len(raw) <= SLICE:
        return raw
    each = SLICE // pieces
    starts = [(len(raw) - each) * k // (pieces - 1) for k in range(pieces)]
    return b"".join(raw[i : i + each] for i in starts)


class Sizer:
    """Bytes that a text takes with each language's dictionary."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.names = [k for k, _ in dictionaries]
        self.encoders = []
        for _, raw in dictionaries:
            # the library wants eight bytes of content at least
            content = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False))

    def sizes(self, text: str) -> np.ndarray:
        raw = letters(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return np.array([sum(len(e.compress(b)) for b in blocks) for e in self.encoders], np.int64)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, accepted). Equal sizes go to the more frequent language."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, False
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        saved = (sizes - sizes[best]) / max(1, int(sizes.max()))
        rivals = np.delete(saved, best)
        return self.names[best], float(1 / np.exp(-STEEP * saved).sum()), bool(not len(rivals) or rivals.min() >= MARGIN)


def predict(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, lang_score and lang_accepted (replacing columns so named).

    Null texts and texts without a letter are ``und``, score 0, not accepted. Every text is encoded whole.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(dictionaries)
    docs = docs.drop("lang_pred", "lang_score", "lang_accepted")
    names = docs.columns
    at = names.index(text_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(known.value)
        for batch in slices(batches, column=at):
            found = [sizer.predict(t) for t in texts_of(batch.column(at))]
            lang, score, accepted = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                [*names, "lang_pred", "lang_score", "lang_accepted"],
            )

    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("lang_score", "double").add("lang_accepted", "boolean")
    return small_batches(docs).mapInArrow(frugal(predicted), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, accepted): fit on the rows that are not held out, predict for all.

    Held out are the rows whose id, as text, has a crc32 divisible by 5. Without any labelled row all is ``und``.
    Repeated rows get equal predictions; an empty table gives an empty result; other columns are not read.
    """
    dictionaries = fit(docs.where(crc_bucket(id_col) != 0), id_col, text_col, lang_col)
    chosen = docs.select(F.col(id_col), (crc_bucket(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    found = predict(chosen, dictionaries)
    return found.select(
        id_col, "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted")
    )
