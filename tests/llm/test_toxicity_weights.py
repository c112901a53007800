"""op9's weights go packed, added up over the shards of a task."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from wayfold.llm import toxicity


@pytest.fixture
def begun():
    rng = np.random.default_rng(3)
    kept = np.arange(0, 40_000, 2)
    spread = rng.integers(3, 90, len(kept))
    return toxicity._begun(kept, spread // 3, spread, spread[:, None], 300.0, 900.0, ["en"], rng)


def rows_of(texts: int, seed: int) -> pa.RecordBatch:
    rng = np.random.default_rng(seed)
    words = [rng.integers(-1, 40_000, (100, 1 + len(toxicity.STEMS)), np.int32) for _ in range(texts)]
    columns = range(texts), np.arange(texts) % 3 // 2, [zstandard.compress(w.tobytes()) for w in words], [100] * texts
    types = pa.int64(), pa.int32(), pa.binary(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["order", "label", "words", "n"])


def sent(model, batch: pa.RecordBatch, ranges: int) -> pa.Table:
    known = SimpleNamespace(value=model)
    return pa.Table.from_batches([*toxicity._descended(known, 0, 1 / 3, ranges)(iter([batch]))])


def summed(model, table: pa.Table, ranges: int) -> dict[int, list[float]]:
    mean, out = toxicity._mean(len(model.embedding) + len(toxicity._whole(model)), ranges), {}
    for r in sorted(set(table.column("range").to_pylist())):
        for row, *values in zip(*mean(table.filter(pa.compute.equal(table.column("range"), r))).to_pydict().values(), strict=True):
            assert row not in out
            out[row] = values
    return out


def test_a_task_sends_a_row_of_weights_once_whatever_its_shards(begun, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 5000)
    batch = rows_of(400, 1)  # eight shards
    table = sent(begun, batch, 16)
    assert len(table) <= 16
    one_by_one = pa.concat_tables([sent(begun, batch.slice(k, 50), 16) for k in range(0, 400, 50)])
    got, want = summed(begun, table, 16), summed(begun, one_by_one, 16)
    assert got.keys() == want.keys() and len(got) > 19_000
    np.testing.assert_allclose([got[k] for k in got], [want[k] for k in got], rtol=1e-5, atol=1e-7)
    # a float for each dimension and some bytes beside; as rows of sums these are 72 bytes for each shard that met them
    assert table.nbytes < 36 * len(got) and 3 * table.nbytes < one_by_one.nbytes


def test_means_are_weighted_by_how_often_a_row_was_met(begun):
    batches = [rows_of(60, 5), rows_of(40, 6)]
    got = summed(begun, pa.concat_tables([sent(begun, b, 4) for b in batches]), 4)
    share, n = [], []
    for b in batches:
        words = np.concatenate([toxicity._unpacked(x) for x in b.column("words").to_pylist()])
        n.append(np.bincount(begun.rows[words].ravel(), minlength=len(begun.embedding)))
        share.append(summed(begun, sent(begun, b, 4), 4))
    both = [r for r in range(1, len(begun.embedding)) if n[0][r] and n[1][r]]
    want = [(n[0][r] * np.array(share[0][r]) + n[1][r] * np.array(share[1][r])) / (n[0][r] + n[1][r]) for r in both]
    np.testing.assert_allclose([got[r] for r in both], want, rtol=1e-5, atol=1e-7)
    last = max(got)  # weights of all texts, by the number of texts
    np.testing.assert_allclose(got[last], 0.6 * np.array(share[0][last]) + 0.4 * np.array(share[1][last]), rtol=1e-5, atol=1e-7)


def test_weights_of_all_tasks_come_back(spark, begun, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 400)
    batch = rows_of(160, 7)  # forty shards
    held = spark.createDataFrame(pa.Table.from_batches([batch])).repartition(40)
    model = toxicity._averaged(held, begun, 0, 1 / 3, 16_000)
    met = np.unique(begun.rows[np.concatenate([toxicity._unpacked(x) for x in batch.column("words").to_pylist()])])
    moved = np.flatnonzero((model.embedding != begun.embedding).any(1))
    assert np.array_equal(moved, met[met > 0])
    assert [f.shape for f in model.filters] == [f.shape for f in begun.filters] and model.out_bias != begun.out_bias
    whole, old = toxicity._whole(model), toxicity._whole(begun)
    assert whole.shape == old.shape and 0 < np.abs(whole - old).max() < 0.5
