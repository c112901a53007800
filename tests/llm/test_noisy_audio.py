"""Alignment of noisy, shifted and partly silent recordings, against brute force over all offsets."""

import numpy as np
import pytest

from wayfold.llm import audio


def flipped(items, rate, rng):
    bits = rng.random((len(items), 32)) < rate
    return items ^ (bits @ (1 << np.arange(32, dtype=np.int64))).astype(np.uint32)


def brute(a, b):
    """(offset, items that meet, rate) of the best offset, or none."""
    found = []
    for o in range(-len(b), len(a) + 1):
        lo, hi = max(0, o), min(len(a), len(b) + o)
        met = [(int(x), int(y)) for x, y in zip(a[lo:hi], b[lo - o : hi - o])] if hi > lo else []
        told = [(x, y) for x, y in met if not x == y == audio.SILENCE]
        wrong = sum((x ^ y).bit_count() for x, y in told)
        if len(met) >= audio.LEAST_ITEMS and len(told) >= audio.LEAST_VOTES and wrong <= audio.MOST_ERRORS * 32 * len(told):
            found.append((32 * len(told) - 2 * wrong, -abs(o), o, len(met), wrong / (32 * len(told))))
    return max(found)[2:] if found else None


@pytest.mark.parametrize("block", [100, 1 << 15])
def test_all_offsets_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(audio, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, 33, np.uint32)
    quiet = np.full(20, audio.SILENCE, np.uint32)
    rows = [base, np.concatenate([quiet, base[:12]]), base[:9]]
    for rate in (0.05, 0.1, 0.15, 0.2, 0.23):
        copy = flipped(base, rate, rng)
        rows += [copy, copy[6:], copy[:20], np.concatenate([rng.integers(0, 1 << 32, 7, np.uint32), copy]), np.concatenate([quiet, copy[:15]])]
    rows += [rng.integers(0, 1 << 32, n, np.uint32) for n in (3, 8, 33, 50)] + [np.concatenate([quiet, rng.integers(0, 1 << 32, 9, np.uint32)]), quiet]
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(rows)], "id long, items array<long>")
    prints = audio.classes(df).cache()
    cls = {r.id: r.cls for r in prints.collect()}
    asked = (0, 1, 4, len(rows) - 1)
    found = {(r.q, r.c): (r.offset, r.n, round(r.rate, 9)) for r in audio.alignments(prints, prints.where(f"id in {asked}")).collect()}
    want = {}
    for q in asked:
        for c in range(len(rows)):
            best = (0, len(rows[q]), 0.0) if c == q else brute(rows[q], rows[c])
            if best:
                want[cls[q], cls[c]] = (*best[:2], round(best[2], 9))
    assert found == want
    assert sum(q == cls[0] for q, _ in found) >= 25
