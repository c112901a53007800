"""Blocks of recordings that meet by products of matrices, against brute force; some are cut, noisy, silent or too short."""

import numpy as np
import pytest
from test_noisy_audio import brute, flipped

from wayfold.llm import audio


@pytest.mark.parametrize("even", [True, False])
def test_products_against_brute_force(even):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 32, (6, 33), np.uint32)
    quiet = np.full(12, audio.SILENCE, np.uint32)
    many = [flipped(x, rate, rng) for x in base for rate in (0.02, 0.15, 0.24, 0.3)]
    if even:
        many += [np.concatenate([quiet, x[:21]]) for x in many[:8]]
    else:
        many += [x[int(rng.integers(0, 9)) : int(rng.integers(20, 34))] for x in many] + [np.concatenate([quiet, x[:13]]) for x in many[:9]] + [x[:n] for x in base for n in (3, 7, 8, 9)] + [quiet] * 2
    asked = many[::2]
    assert max(map(len, audio._alike(asked))) >= audio.FEW
    found = {(i, j): (o, n, round(rate, 9)) for i, j, o, n, rate in zip(*(x.tolist() for x in audio.best_offsets(asked, many)), strict=True)}
    want = {(i, j): (*best[:2], round(best[2], 9)) for i, a in enumerate(asked) for j, b in enumerate(many) if (best := brute(a, b))}
    assert found == want and len(found) > len(asked)
