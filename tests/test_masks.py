"""Masks: fitting, joining with prototypes, and the way back, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import masks


def test_fitting_keeps_the_picture():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (12, 20, 3), dtype=np.uint8)
    out = masks.letterboxed(rgb, 20)
    assert out.shape == (3, 20, 20) and np.allclose(out[:, 4:16].transpose(1, 2, 0), rgb / 255)
    assert np.allclose(out[:, :4], masks.PAD) and np.allclose(out[:, 16:], masks.PAD)
    flat = masks.letterboxed(np.full((50, 30, 3), 51, np.uint8), 16)
    scale, left, top = masks.fit(30, 50, 16)
    assert (scale, left, top) == (pytest.approx(0.32), pytest.approx(3.2), 0.0)
    assert np.allclose(flat[:, :, 3:13], 0.2) and np.allclose(flat[:, :, :3], masks.PAD) and np.allclose(flat[:, :, 13:], masks.PAD)


def test_pads_within_a_pixel():
    """Each covered pixel against a plain loop over its place in the image."""
    rgb = np.random.default_rng(4).integers(0, 256, (23, 37, 3), dtype=np.uint8)
    out = masks.letterboxed(rgb, 32)
    scale, left, top = masks.fit(37, 23, 32)
    for y in range(32):
        for x in range(32):
            if not (math.floor(top) <= y < math.ceil(top + 23 * scale) and math.floor(left) <= x < math.ceil(left + 37 * scale)):
                assert np.allclose(out[:, y, x], masks.PAD)
                continue
            u, v = (min(max((p + 0.5 - pad) / scale - 0.5, 0), n - 1) for p, pad, n in ((x, left, 37), (y, top, 23)))
            i, j = int(u), int(v)
            k, m = min(i + 1, 36), min(j + 1, 22)
            want = (rgb[j, i] * (1 - u + i) + rgb[j, k] * (u - i)) * (1 - v + j) + (rgb[m, i] * (1 - u + i) + rgb[m, k] * (u - i)) * (v - j)
            assert np.allclose(out[:, y, x], want / 255, atol=1e-6)


def test_best_class(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9, 0.3]), (2, [0.5, 0.2, 0.5]), (3, [0.1, 0.1, 0.1])], "anchor int, scores array<double>")
    found = {r.anchor: (r["class"], r.score) for r in masks.detected(df, [], [0, 2], 0.2).collect()}
    assert found == {1: (2, 0.3), 2: (0, 0.5)}
    assert masks.class_ids("person") == (0,) and masks.class_ids([3, 4]) == (3, 4)
    with pytest.raises(ValueError):
        masks.class_ids("animals")


def test_union_and_the_way_back(spark):
    rng = np.random.default_rng(2)
    values, dets = rng.normal(size=(8, 8, 4)), [(rng.normal(size=4), 1, 1, 6, 7), (rng.normal(size=4), 0, 3, 8, 5)]
    p = spark.createDataFrame([(0, u, v, values[v, u].tolist()) for u in range(8) for v in range(8)], "f int, u int, v int, values array<double>")
    d = spark.createDataFrame([(0, c.tolist(), *b) for c, *b in dets], "f int, coefficients array<double>, x0 int, y0 int, x1 int, y1 int")
    want = {(u, v) for u in range(8) for v in range(8) if any(x0 <= u < x1 and y0 <= v < y1 and c @ values[v, u] > 0 for c, x0, y0, x1, y1 in dets)}
    mask = masks.united(d, p, ["f"])
    assert {(r.u, r.v) for r in mask.collect()} == want
    size, side = (30, 20), 32
    scale, left, top = masks.fit(*size, side)
    back = {(u, v) for u in range(30) for v in range(20) if (math.floor(((u + 0.5) * scale + left) / 4), math.floor(((v + 0.5) * scale + top) / 4)) in want}
    found = masks.at_source(mask, ["f"], 8, side, size)
    assert {(r.u, r.v) for r in found.collect()} == back and found.count() == len(back)
    assert masks.coverage(found, ["f"], size).first().share == pytest.approx(len(back) / 600)


@pytest.mark.parametrize(("n", "most"), [(10, 4), (7, 7), (3, 5), (100, 7)])
def test_frames_evenly(spark, n, most):
    found = sorted(r.id for r in masks.evenly(spark.range(n).withColumn("k", F.lit(1)), ["k"], ["id"], most).collect())
    assert found == sorted({i * n // most for i in range(most)} if n > most else set(range(n)))
