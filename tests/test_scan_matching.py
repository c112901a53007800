"""The two nearest references are the same by all distances and by the grid, and a scan takes few milliseconds."""

import math
import time

import numpy as np
import pytest

from wayfold.operators import registration


@pytest.mark.parametrize("seed", range(6))
def test_all_distances_and_the_grid_agree(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    points = np.round(rng.uniform(-4, 4, (rng.integers(1, 80), 2)), 1 if seed % 2 else 6)  # with ties and copies
    queries = np.round(rng.uniform(-6, 6, (90, 2)), 1 if seed % 2 else 6)
    near = registration.Neighbours(points, 1.03)
    dense = near.two(queries)
    monkeypatch.setattr(registration, "DENSE", 0)
    for a, b in zip(dense, near.two(queries), strict=True):
        assert np.array_equal(a, b)


def test_a_lookup_does_not_sort_all_pairs(monkeypatch):
    angle = np.arange(240) * 2 * math.pi / 240
    points = np.stack([3 * np.cos(angle), 2 * np.sin(angle)], 1)
    near = registration.Neighbours(points, 1.0)

    def took():
        began = time.process_time()
        for _ in range(20):
            near.two(points + 0.01)
        return time.process_time() - began

    fast = min(took() for _ in range(3))
    monkeypatch.setattr(registration, "DENSE", 0)
    assert 1.5 * fast < min(took() for _ in range(3))
