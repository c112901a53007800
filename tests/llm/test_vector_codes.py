import hashlib
import math

import numpy as np
import pytest

from wayfold.llm import vector_codes as vc


def plain(rows, rounds=2, entries=64):
    """{id: (code, error, sha)} by all distances in every round."""
    kept = sorted((i, [math.floor(256 * x) for x in v]) for i, v in rows)
    out = {}
    for width in {len(v) for _, v in kept}:
        some = [(i, v) for i, v in kept if len(v) == width]
        ends = vc.part_ends(width)
        books = [[v[a:b] for _, v in some[:entries]] for a, b in zip(ends, ends[1:])]
        near = lambda x, book: min(range(len(book)), key=lambda e: (sum((p - q) ** 2 for p, q in zip(x, book[e])), e))
        for _ in range(rounds):
            for k, (a, b) in enumerate(zip(ends, ends[1:])):
                groups = {}
                for _, v in some:
                    groups.setdefault(near(v[a:b], books[k]), []).append(v[a:b])
                books[k] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else x for e, x in enumerate(books[k])]
        sha = hashlib.sha256(",".join(str(c) for book in books for x in book for c in x).encode()).hexdigest()
        for i, v in some:
            found = [near(v[a:b], book) for a, b, book in zip(ends, ends[1:], books)]
            error = sum((p - q) ** 2 for e, a, b, book in zip(found, ends, ends[1:], books) for p, q in zip(v[a:b], book[e]))
            out[i, tuple(v)] = ("".join(f"{e:02x}" for e in found), error, sha)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1.0) for i, v, label in rows], "vec_id long, embedding array<float>, label int, width string, error double")


def check(spark, rows):
    fine = [(i, v, label) for i, v, label in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = plain([(i, v) for i, v, _ in fine])
    by_label = {}
    for i, v, label in fine:
        by_label[label] = by_label.get(label, 0) + want[i, tuple(math.floor(256 * x) for x in v)][1]
    wanted = sorted((i, *want[i, tuple(math.floor(256 * x) for x in v)][:2], by_label[label], want[i, tuple(math.floor(256 * x) for x in v)][2]) for i, v, label in fine)
    found = vc.codes(frame(spark, rows))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in found.collect()) == wanted


def test_codes_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(0, 0.2, (400, 32)) + rng.integers(0, 3, (400, 1))).astype(np.float32)
    check(spark, [(i * 7 % 1000, v.tolist(), i % 5 if i % 3 else None) for i, v in enumerate(vectors)])


def test_nulls_ties_repeats_and_widths(spark):
    rows = [(1, [0.25] * 16, 1), (1, [0.25] * 16, 1), (2, [0.5] * 16, None), (3, [0.375] * 16, 2), (4, None, 2), (5, [None] + [0.0] * 15, 2), (6, [float("nan")] * 16, 2), (7, [float("inf")] * 16, 1)]
    rows += [(None, [0.1] * 16, 1), (8, [-0.001, 3.5, 0.2], 1), (9, [], 4), (10, [1.0, 2.0, -3.0], None), (11, [0.1 * k for k in range(20)], 1), (12, [0.2 * k for k in range(20)], 7)]
    check(spark, rows)


def test_no_vectors(spark):
    assert vc.codes(frame(spark, [])).collect() == [] and vc.codes(frame(spark, [(1, None, 1)])).collect() == []


def test_bounds_prune_and_hold():
    """Later rounds compute few of the distances, and no bound is ever on the wrong side."""
    rng = np.random.default_rng(5)
    x = (rng.integers(0, 8, (2000, 1)) * 100 + rng.integers(-6, 7, (2000, 4))).astype(np.int64)
    entries = x[:64]
    near, upper, lower = vc.assigned(x, entries)
    total = 0
    for _ in range(4):
        new = np.array([x[near == e].sum(0) // max(1, (near == e).sum()) if (near == e).any() else entries[e] for e in range(64)])
        way = np.sqrt(((new - entries) ** 2).sum(1))
        upper, lower = vc.moved(near, upper, lower, way)
        near, upper, lower, n = vc.reassigned(x, new, near, upper, lower)
        d2 = vc.squares(x, new)
        assert (near == d2.argmin(1)).all()
        assert (lower <= np.sqrt(d2)).all() and (upper >= np.sqrt(d2[np.arange(2000), near])).all()
        entries, total = new, total + n
    assert total < 0.5 * 4 * 2000 * 64


def test_written_bounds_stay_below():
    x = np.concatenate([np.geomspace(1e-8, 1e9, 5000), [0.0]]).astype(np.float32)
    assert (vc.kept(x).astype(float) <= x).all() and (vc.kept(x[(x > 1) & (x < 1e4)]) > 0.998 * x[(x > 1) & (x < 1e4)]).all()


def test_hot_label_and_many_labels(spark):
    rows = [(i, [i / 500.0] * 16, 1 if i % 3 == 0 else i) for i in range(600)]
    check(spark, rows)


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        vc.codes(frame(spark, [(1, [1e30] * 16, 1)])).collect()
