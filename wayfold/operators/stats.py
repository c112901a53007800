"""Errors, latencies and benchmark tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.folds import folded
from wayfold.operators.lineage import cut


def latency_stats(df: DataFrame, key: Sequence[str], ns: str) -> DataFrame:
    """(key, p50, p95, p99, max, mean) in microseconds; percentiles are nearest ranks."""
    us = F.col(ns).cast("double") / 1000.0
    ranks = df.withColumn("__us", us).groupBy(*key).agg(
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY __us)").alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)], F.max("__us").alias("max"), F.avg("__us").alias("mean")
    )
    return ranks


def throughput(df: DataFrame, key: Sequence[str], stamp: str, wall_s: Column) -> DataFrame:
    """(key, n, span_s, throughput_hz, real_time_factor); rates are 0 where no time passed."""
    out = df.groupBy(*key).agg(F.count("*").alias("n"), ((F.max(stamp) - F.min(stamp)) * F.lit(1e-9)).alias("span_s"), wall_s.alias("__w"))
    rate = lambda x: F.when(F.col("__w") > 0, x / F.col("__w")).otherwise(0.0)
    return out.select(*key, "n", "span_s", rate(F.col("n")).alias("throughput_hz"), rate(F.col("span_s")).alias("real_time_factor"))


def mean_std(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """(key, mean, std): population figures of the values that are neither null nor NaN; NaN of none."""
    v = F.when(~F.isnan(column), F.col(column))
    return df.groupBy(*key).agg(F.coalesce(F.avg(v), F.lit(float("nan"))).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(float("nan"))).alias("std"))


def error_stats(df: DataFrame, key: Sequence[str], error: str) -> DataFrame:
    """(key, rmse, mean, median, std, min, max)."""
    e = F.col(error)
    return df.groupBy(*key).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean"), F.expr(f"percentile({error}, 0.5)").alias("median"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max")
    )


def absolute_error(pairs: DataFrame, key: Sequence[str], est: Sequence[str], ref: Sequence[str], align: bool = False) -> DataFrame:
    """Six-number summary of the distances between associated poses, after a rigid fit if ``align``.

    The fit needs sums only: they are taken in one aggregation, a 3 x 3 decomposition per key gives the motion, and
    the errors are taken after a join with it. Degenerate geometry is left unaligned.
    """
    if align:
        motion = _fits(pairs, key, est, ref)
        pairs = pairs.join(motion, list(key))
        moved = [sum(F.col("r")[3 * i + j] * F.col(est[j]) for j in range(3)) + F.col("t")[i] for i in range(3)]
    else:
        moved = [F.col(c) for c in est]
    d2 = sum((m - F.col(c)) ** 2 for m, c in zip(moved, ref, strict=True))
    return error_stats(pairs.withColumn("__e", F.sqrt(d2)), key, "__e")


def _fits(pairs: DataFrame, key: Sequence[str], est: Sequence[str], ref: Sequence[str]) -> DataFrame:
    sums = [F.count("*").alias("n")] + [F.sum(c).alias(f"s_{c}") for c in (*est, *ref)] + [F.sum(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a in ref for b in est]
    gathered = pairs.groupBy(*key).agg(*sums)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rs, ts = [], []
            for row in f.to_dict("records"):
                n = row["n"]
                p, q = (np.array([row[f"s_{c}"] for c in names]) / n for names in (est, ref))
                cov = np.array([[row[f"c_{a}_{b}"] for b in est] for a in ref]) / n - np.outer(q, p)
                u, s, vt = np.linalg.svd(cov)
                r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt if s[1] > 1e-12 else np.eye(3)
                rs.append(r.ravel().tolist())
                ts.append((q - r @ p).tolist() if s[1] > 1e-12 else [0.0] * 3)
            yield pd.DataFrame({**{k: f[k] for k in key}, "r": rs, "t": ts})

    kinds = ", ".join(f"`{k}` {gathered.schema[k].dataType.simpleString()}" for k in key)
    return gathered.mapInPandas(solve, f"{kinds}, r array<double>, t array<double>")


def relative_pairs(df: DataFrame, key: Sequence[str], order: Sequence[str], xyz: Sequence[str], delta: float) -> DataFrame:
    """Consecutive segment ends: the first row of each stretch of ``delta`` along the path, joined with the next one's."""
    w = Window.partitionBy(*key).orderBy(*order)
    step = F.coalesce(F.sqrt(sum((F.col(c) - F.lag(c).over(w)) ** 2 for c in xyz)), F.lit(0.0))
    far = df.withColumn("__s", step).withColumn("along", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    far = far.withColumn("segment", F.floor(F.col("along") / delta))
    starts = far.withColumn("__n", F.row_number().over(Window.partitionBy(*key, "segment").orderBy(*order))).where("__n = 1").drop("__n", "__s")
    again = Window.partitionBy(*key).orderBy("segment")
    return starts.withColumns({f"next_{c}": F.lead(c).over(again) for c in (*xyz, "along")}).where("next_along is not null")


def normal_equations(df: DataFrame, key: Sequence[str], nx: str, ny: str, px: str, py: str, residual: str) -> DataFrame:
    """Sums of J J^T and J r for planar point-to-line residuals, J = (nx, ny, ny px - nx py)."""
    j = {"0": F.col(nx), "1": F.col(ny), "2": F.col(ny) * F.col(px) - F.col(nx) * F.col(py)}
    h = [F.sum(j[a] * j[b]).alias(f"h{a}{b}") for a in j for b in j if a <= b]
    return df.groupBy(*key).agg(*h, *[F.sum(v * F.col(residual)).alias(f"g{a}") for a, v in j.items()])


def trimmed(df: DataFrame, key: Sequence[str], residual: str, seq: str, trim: float = 0.2) -> DataFrame:
    """Rows with the smallest absolute residuals, all but the share ``trim``, rounded down."""
    w = Window.partitionBy(*key)
    rank = F.row_number().over(w.orderBy(F.abs(residual), seq))
    return df.withColumns({"__n": F.count("*").over(w), "__r": rank}).where(F.col("__r") <= F.floor(F.col("__n") * (1 - trim))).drop("__n", "__r")


def weak_direction(h00: Column, h01: Column, h11: Column, ratio: float) -> tuple[Column, Column]:
    """Unit eigenvector of the smaller eigenvalue, where it is at most ``ratio`` of the larger; null elsewhere."""
    # the strong axis stands at half the angle of (h00 - h11, 2 h01), whose length parts the eigenvalues
    strong, apart = F.atan2(2 * h01, h00 - h11) / 2, F.hypot(h00 - h11, 2 * h01)
    weak = h00 + h11 - apart <= ratio * (h00 + h11 + apart)
    return F.when(weak, -F.sin(strong)), F.when(weak, F.cos(strong))


def best_pick(df: DataFrame, key: Sequence[str], name: str, value: str, smallest: bool = True) -> DataFrame:
    """(key, name, value) of the best row of each key; the smaller name on ties, rows without a value never."""
    order = F.struct(F.col(value) if smallest else -F.col(value), F.col(name))
    found = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*key).agg(F.min_by(F.struct(name, value), order).alias("b"))
    return found.select(*key, f"b.{name}", f"b.{value}")


def mean_in_order(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(key, mean): values are added one after another in their order, so the last digit doesn't hang on how rows are dealt."""
    w = Window.partitionBy(*key).orderBy(*order)
    running = F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({"mean": running, "__last": F.lead(F.lit(1)).over(w).isNull()}).where("__last").select(*key, "mean")


def best_mean(df: DataFrame, key: Sequence[str], name: str, value: str, order: Sequence[str], digits: int) -> DataFrame:
    """(key, name, mean) of the name with the smallest mean, see :func:`best_pick`; means are those of :func:`mean_in_order`.

    Sums of doubles in any order lie within ``slack`` of each other. Only the rows of keys whose best name, or its mean
    when rounded to ``digits``, that much can change are sorted; the result is the same as if all were.
    """
    slack = F.count(value) * F.avg(F.abs(value)) * 2.0**-51
    found = df.groupBy(*key, name).agg(F.avg(value).alias("mean"), slack.alias("__slack")).where("mean is not null and not isnan(mean)")
    found = found.withColumns({"__low": F.col("mean") - F.col("__slack"), "__high": F.col("mean") + F.col("__slack")})
    near = found.withColumn("__reach", F.min("__high").over(Window.partitionBy(*key))).where("__low <= __reach or isnan(__low)")
    unsure = (F.count("*") > 1) | F.max(F.round("__low", digits) != F.round("__high", digits))
    picked = cut(near.groupBy(*key).agg(F.min_by(F.struct(name, "mean"), F.struct("mean", name)).alias("b"), unsure.alias("__open")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    rows = df.alias("l").join(picked.where("__open").select(*key).alias("r"), reduce(Column.__and__, same), "left_semi")
    sure = picked.where("not __open").select(*key, f"b.{name}", "b.mean")
    return sure.unionByName(best_pick(mean_in_order(rows, [*key, name], value, order), key, name, "mean"))


def gated(figures: DataFrame, checks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(check, passed, shown) for each (name, figure shown, condition) on a table of one row; a null condition fails."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed"), F.col(s).cast("double").alias("shown")) for n, s, c in checks])
    return figures.select(F.explode(rows).alias("r")).select("r.*")


def arc_pairs(df: DataFrame, key: str, order: Sequence[str], xyz: Sequence[str], delta: float, carried: Sequence[str] = ()) -> DataFrame:
    """(key, from_, to_, length): pairs of rows between which the path is ``delta`` long at least, one after another: each begins where the one before ended.

    Numbers of the rows named in ``carried`` come along.
    """
    return folded(df, lambda: _Arc((*xyz, *carried), len(xyz), delta), key, order)


class _Arc:
    def __init__(self, names: tuple[str, ...], size: int, delta: float):
        self.names, self.size, self.delta = names, size, delta
        self.columns = ", ".join(f"{p}{n} double" for p in ("from_", "to_") for n in names) + ", length double"
        self.start, self.before, self.length = None, None, 0.0

    def step(self, row) -> dict | None:
        here = tuple(row[n] for n in self.names)
        if self.start is None:
            self.start = self.before = here
            return None
        self.length += math.dist(self.before[: self.size], here[: self.size])
        self.before = here
        if self.length < self.delta:
            return None
        out = {f"{p}{n}": v for p, t in (("from_", self.start), ("to_", here)) for n, v in zip(self.names, t, strict=True)} | {"length": self.length}
        self.start, self.length = here, 0.0
        return out


def pivot_best(df: DataFrame, row: str, column: str, value: str, values: Sequence[str], smallest: bool = True) -> DataFrame:
    """One row per ``row`` with the mean of each column's values, and the best of them."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.avg(value))
    pick = F.least if smallest else F.greatest
    return wide.withColumn("best", pick(*[F.col(v) for v in values]))
