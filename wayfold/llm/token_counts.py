"""Token counts by a two-tier lookup.

Tier one is a broadcast table with the token counts of the corpus's most frequent text runs, at most
``FREQUENT`` of them whatever the corpus size, found in a bounded sample of rows. Tier two is a bounded cache in
each Python worker for the rest. No run is shuffled: the sample's repeated runs go to the driver, texts go nowhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import bpe
from wayfold.llm.common import small_batches, texts_of

#: Entries of the broadcast table; about 2 MB.
FREQUENT = 32_768
#: Rows that the table is made from, drawn at random. They move work between the tiers, not results.
SAMPLED = 4_096
#: Entries of a task's summary while it counts, and of what it hands on.
SUMMARY, HANDED_ON = 200_000, 4_096
#: Entries of a worker's cache.
CACHED = 400_000


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's frequent runs: Misra-Gries with deletions in bulk. Runs met once in a task are not worth an entry."""
    seen: Counter = Counter()
    for batch in batches:
        for text in texts_of(batch.column(0)):
            if text:
                seen.update(bpe.runs(text))
                if len(seen) > 2 * SUMMARY:
                    least = sorted(seen.values(), reverse=True)[SUMMARY]
                    seen = Counter({k: v - least for k, v in seen.items() if v > least})
    top = [x for x in seen.most_common(HANDED_ON) if len(x[0]) < 100 and x[1] > 1]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["run", "n"])


def frequent_runs(docs: DataFrame, text_col: str = "text", most: int = FREQUENT) -> dict[str, int]:
    """Token counts of at most ``most`` frequent runs. It only speeds the count up; any table gives the same counts."""
    sample = docs.select(F.col(text_col).alias("text")).sample(min(1.0, SAMPLED / max(1, docs.count())), 7)
    seen: Counter = Counter()
    for r in sample.mapInArrow(_summaries, "run string, n long").collect():
        seen[r.run] += r.n
    return {run: bpe.count(run) for run, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``, copies included.

    The counts are those of the JSON tokenizer without added special tokens, truncation or padding. A null text
    counts as empty: 0 bytes, 0 tokens. Texts of any length are encoded whole; an empty table gives an empty
    result; columns other than the two named are not read.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_runs(docs, text_col))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe.BoundedCache(bpe.count, CACHED, table.value)
        for batch in batches:
            size, n = [], []
            for text in texts_of(batch.column(1)):
                size.append(len(text.encode()) if text else 0)
                n.append(sum(map(tokens.__getitem__, bpe.runs(text))) if text else 0)
            n = np.asarray(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = chosen.schema[0].dataType.simpleString()
    return small_batches(chosen).mapInArrow(counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
