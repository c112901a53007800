"""Masks of moving things: images fitted to a model's square, detections joined with prototypes, and masks back at the image's size."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a pad is filled with, as a share of full light.
PAD = 114 / 255
#: Numbers of the common classes, for people alone and for what moves or is moved (people, vehicles, animals,
#: bags, furniture, devices).
CLASSES = {"person": (0,), "dynamic": (0, 1, 2, 3, 5, 6, 7, 8, 14, 15, 16, 17, 24, 25, 26, 28, 32, 56, 57, 58, 63, 67)}


def class_ids(name: str | Sequence[int]) -> tuple[int, ...]:
    """The numbers of a named set of classes, or those given."""
    if isinstance(name, str):
        if name not in CLASSES:
            raise ValueError(f"no classes {name}")
        return CLASSES[name]
    return tuple(int(c) for c in name)


def fit(width: int, height: int, side: int) -> tuple[float, float, float]:
    """(scale, left pad, top pad) of an image fitted to a square; pads may end within a pixel."""
    scale = min(side / width, side / height)
    return scale, (side - width * scale) / 2, (side - height * scale) / 2


def letterboxed(rgb: np.ndarray, side: int) -> np.ndarray:
    """(3, side, side) single-precision light of an 8-bit image (height, width, 3), resized bilinearly, the rest padded.

    Pixels that the image covers in part are taken from it as a whole.
    """
    height, width = rgb.shape[:2]
    scale, left, top = fit(width, height, side)
    out = np.full((3, side, side), PAD, np.float32)

    def places(size: int, pad: float) -> tuple[slice, np.ndarray, np.ndarray, np.ndarray]:
        span = slice(max(math.floor(pad), 0), min(math.ceil(pad + size * scale), side))
        at = np.clip((np.arange(span.start, span.stop) + 0.5 - pad) / scale - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return span, low, np.minimum(low + 1, size - 1), (at - low)

    (across, x0, x1, fx), (down, y0, y1, fy) = places(width, left), places(height, top)
    light = rgb.astype(np.float64) / 255
    row = lambda y: light[y][:, x0] * (1 - fx)[:, None] + light[y][:, x1] * fx[:, None]
    out[:, down, across] = (row(y0) * (1 - fy)[:, None, None] + row(y1) * fy[:, None, None]).transpose(2, 0, 1)
    return out


def detected(predictions: DataFrame, key: Sequence[str], classes: Sequence[int], least: float) -> DataFrame:
    """``predictions`` (key, anchor, scores array, ...) whose best score among ``classes`` is ``least`` or more, with ``score`` and ``class``."""
    scores = F.array(*[F.struct(F.get("scores", F.lit(c)).alias("score"), F.lit(-c).alias("order")) for c in classes])
    best = F.array_max(F.filter(scores, lambda s: s["score"].isNotNull()))
    found = predictions.withColumn("__b", best).where(F.col("__b.score") >= least)
    return found.withColumns({"score": F.col("__b.score"), "class": -F.col("__b.order")}).drop("__b", "scores")


def united(detections: DataFrame, prototypes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, u, v): pixels of the prototypes' grid that some detection covers.

    ``detections`` has (key, coefficients, x0, y0, x1, y1 on that grid), ``prototypes`` (key, u, v, values). Inside its box a
    detection covers the pixels at which the product of its coefficients with the prototypes' values is above 0.
    """
    met = prototypes.join(detections.select(*key, "coefficients", "x0", "y0", "x1", "y1"), list(key))
    met = met.where((F.col("u") >= F.col("x0")) & (F.col("u") < F.col("x1")) & (F.col("v") >= F.col("y0")) & (F.col("v") < F.col("y1")))
    return met.where(_product("coefficients", "values") > 0).select(*key, "u", "v").distinct()


def _product(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def at_source(mask: DataFrame, key: Sequence[str], grid: int, side: int, size: tuple[int, int]) -> DataFrame:
    """(key, u, v): pixels of an image of the given size whose place in the model's square falls on a pixel of the ``mask`` (key, u, v).

    Each grid pixel takes the image's pixels whose centres lie in it, so pads cover nothing.
    """
    scale, left, top = fit(*size, side)
    cell = side / grid

    def span(c: str, pad: float, n: int, i: str) -> Column:
        first = F.ceil((F.col(c) * cell - pad) / scale - 0.5)
        last = F.ceil(((F.col(c) + 1) * cell - pad) / scale - 0.5) - 1
        lo, hi = F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")).alias(i)

    spans = mask.select(*key, span("u", left, size[0], "us"), span("v", top, size[1], "vs"))
    return spans.select(*key, F.explode("us").alias("u"), "vs").select(*key, "u", F.explode("vs").alias("v"))


def coverage(mask: DataFrame, key: Sequence[str], size: tuple[int, int]) -> DataFrame:
    """(key, share): how much of an image of that size a mask of distinct pixels covers."""
    return mask.groupBy(*key).agg((F.count("*") / float(size[0] * size[1])).alias("share"))


def evenly(frames: DataFrame, key: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` frames of each key, evenly over its length: numbers floor(i * n / most)."""
    w = Window.partitionBy(*key)
    numbered = frames.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    # i is taken if some whole k has floor(k * n / most) = i
    k = F.ceil(F.col("__i") * most / F.col("__n"))
    return numbered.where((F.col("__n") <= most) | (F.floor(k * F.col("__n") / most) == F.col("__i"))).drop("__i", "__n")
