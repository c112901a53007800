"""Suffixes across boundaries, texts of one character, a passage in every text, columns of any name."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_dedup import overlapping, repeated

from wayfold.llm import suffix_dedup


@pytest.mark.parametrize("seed", [5, 6])
def test_boundaries_in_hot_keys(docs, monkeypatch, seed):
    # many buckets for few suffixes: nearly every key is that of a splitter
    monkeypatch.setattr(suffix_dedup, "LEAST_BUCKETS", 40)
    monkeypatch.setattr(suffix_dedup, "SENT", 200)
    monkeypatch.setattr(suffix_dedup, "ANCHORS", 300)
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = overlapping(seed) + [(100 + k, "".join(rng.choice("uvwxyz") for _ in range(rng.randrange(0, 60))) + passage + "".join(rng.choice("uvwxyz") for _ in range(40)), "en") for k in range(60)]
    assert sorted(map(tuple, suffix_dedup.digests(docs(rows).repartition(5)).collect()), key=str) == repeated(rows)


@pytest.mark.parametrize("seed", [7, 8])
def test_buckets_in_parts(docs, monkeypatch, seed):
    # a bucket of some thousand rows is taken in many ranges
    monkeypatch.setattr(suffix_dedup, "PART", 64)
    monkeypatch.setattr(suffix_dedup, "SENT", 300)
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60, 300))) for _ in range(12)]
    rows = overlapping(seed) + [(100 + k, "".join(rng.choice(passages) + str(k) for _ in range(rng.randrange(4))), "en") for k in range(60)]
    assert sorted(map(tuple, suffix_dedup.digests(docs(rows).repartition(4)).collect()), key=str) == repeated(rows)


def test_parts_keep_keys_together():
    rng = np.random.default_rng(3)
    blocks, whole = [], []
    for k in range(9):
        rows = np.zeros((rng.integers(1, 4000), suffix_dedup.RIGHT_WIDTH), np.uint8)
        rows[:, :3] = rng.integers(97, 100, (len(rows), 3))
        rows = rows[np.lexsort(rows.T[::-1])]
        ids = np.arange(len(rows)) + 10_000 * k
        blocks.append(suffix_dedup._packed_bytes(suffix_dedup.SINGLE, 0, rows, [ids.astype(np.uint32)], np.zeros(len(rows), np.int64), np.array([k]), np.array([k])))
        whole += [(i, bytes(r)) for i, r in zip(ids.tolist(), rows, strict=True)]
    table = pa.Table.from_batches(blocks)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffix_dedup, "PART", 2000)
        parts = list(suffix_dedup._parts(table, suffix_dedup.RIGHT_WIDTH, suffix_dedup.WINDOW, np.uint32))
    found, keys = [], []
    for p in parts:
        rows, (place,), *_ = suffix_dedup._unpacked_bytes(p, suffix_dedup.RIGHT_WIDTH, np.uint32)
        found += [(i, bytes(r)) for i, r in zip(place.tolist(), rows, strict=True)]
        keys.append({bytes(r) for r in rows})
    assert len(parts) > 3 and sorted(found) == sorted(whole) and sum(map(len, keys)) == len(set().union(*keys))


def test_a_text_of_one_character(docs):
    rows = [(1, "x" * (1 << 20), "en"), (2, "y" * 60 + "x" * 100, "en"), (3, "x" * 49, "en"), (0, "ab" * 30 + "x" * 70, "en"), (4, "ab" * 100_000, "en")]
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.digests(docs(rows)).collect()}
    assert found == {0: (0, 0), 1: (1 << 20, 1), 2: (100, 1), 3: (0, 0), 4: (200_000, 1)}


def test_one_character_sends_few_anchors():
    (s,) = list(suffix_dedup.stretches([b"x" * 200_000]))
    assert len(s) > 150_000 and (s.leaders() == np.arange(len(s))).sum() == 1


def test_columns_of_any_name(spark):
    text = "one passage that is long enough to be found in both of the two texts here"
    for clash in ("row", "id", "tid", "text", "gone", "windows", "open", "left", "bucket", "kind", "data"):
        if clash == "text":
            continue
        rows = spark.createDataFrame([(1, text, "a"), (2, text, "b")], f"doc_id long, text string, `{clash}` string")
        left = {r.doc_id: (r.text, r[clash]) for r in suffix_dedup.without_repeats(rows).collect()}
        assert left == {1: (text, "a"), 2: ("", "b")}
    rows = spark.createDataFrame([(1, text, "a"), (2, text, "b")], "doc_id long, text string, removed string")
    assert {r.doc_id: r.removed for r in suffix_dedup.repeated_spans(rows).collect()} == {1: [], 2: [0, len(text)]}
    assert suffix_dedup.repeated_spans(rows.where("doc_id < 0")).count() == 0
