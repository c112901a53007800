"""Keys of op4 are dealt evenly over their buckets."""

import numpy as np
import pyarrow as pa

from wayfold.llm import suffix_dedup


def test_keys_are_dealt_evenly():
    letters = np.random.default_rng(4).integers(97, 123, 1 << 20, np.uint8).tobytes().decode()
    texts = [letters[k : k + 4096] for k in range(0, len(letters), 4096)]
    ids = pa.array(range(len(texts)), pa.int64())
    sent = suffix_dedup._anchors(64)(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["id", "tid", "text"])]))
    size = np.zeros(64, np.int64)
    for batch in sent:
        for bucket, kind, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
            if kind == suffix_dedup.ENTRIES:
                size[bucket] += len(suffix_dedup._unpack(data[4 + int.from_bytes(data[:4], "little") :], np.uint32, np.uint64, np.uint32, np.uint8)[0])
    assert size.sum() > 50_000
    assert size.max() < 1.3 * size.mean() and size.min() > 0.7 * size.mean()
