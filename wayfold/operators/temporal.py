"""Operators over time-ordered streams. Every order ends in a unique column, so results don't depend on arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geometry import wrap_angle


def merge_streams(streams: Sequence[DataFrame], rank: str = "kind_rank") -> DataFrame:
    """Union of streams with each one's place in ``streams``; sorting by (stamp, rank, sequence) merges them stably."""
    out = None
    for k, s in enumerate(streams):
        s = s.withColumn(rank, F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def interpolate_at(base: DataFrame, other: DataFrame, key: Sequence[str], time: str, base_seq: str, other_seq: str, value: str, out: str) -> DataFrame:
    """Rows of ``base`` within the time span of ``other``, with ``other``'s value interpolated linearly; see :func:`interpolated_at`."""
    return interpolated_at(base, other, key, time, base_seq, other_seq, {out: value})


def interpolated_at(base: DataFrame, other: DataFrame, key: Sequence[str], time: str, base_seq: str, other_seq: str, values: dict[str, str]) -> DataFrame:
    """Rows of ``base`` within the time span of ``other``, with columns of ``other`` (new name -> column) interpolated linearly.

    The bracket is the last row strictly earlier, or else the first one, and the one after it; rows of ``base``
    outside the span are dropped, its ends are kept; a bracket without length gives its first value. One sort of
    the union replaces a join on time, however many columns there are.
    """
    cols, names = [*key, time], [f"v{k}" for k in range(len(values))]
    kind = f"struct<t:bigint,{','.join(f'{n}:double' for n in names)}>"
    a = base.select(*cols, F.struct(*base.columns).alias("row"), F.lit(None).cast(kind).alias("obs"), F.col(base_seq).alias("seq"), F.lit(0).alias("side"))
    obs = F.struct(F.col(time).alias("t"), *[F.col(c).cast("double").alias(n) for n, c in zip(names, values.values(), strict=True)])
    b = other.select(*cols, F.lit(None).alias("row"), obs.alias("obs"), F.col(other_seq).alias("seq"), F.lit(1).alias("side"))
    # base rows come before other rows of the same stamp, so what came before is strictly earlier
    ordered = Window.partitionBy(*key).orderBy(time, "side", "seq")
    ahead = ordered.rowsBetween(1, Window.unboundedFollowing)
    joined = a.unionByName(b).withColumns(
        {
            "before": F.last("obs", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
            "after": F.first("obs", ignorenulls=True).over(ahead),
        }
    )
    lo, hi = F.coalesce("before", "after"), F.col("after")
    inside = F.col("row").isNotNull() & hi.isNotNull() & (F.col("before").isNotNull() | (hi["t"] == F.col(time)))
    dt = hi["t"] - lo["t"]
    w = F.when(dt == 0, F.lit(0.0)).otherwise((F.col(time) - lo["t"]) / dt)
    return joined.where(inside).select("row.*", *[(lo[n] + w * (hi[n] - lo[n])).alias(out) for n, out in zip(names, values, strict=True)])


def latest_before(base: DataFrame, other: DataFrame, key: Sequence[str], time: str, base_seq: str, other_seq: str, columns: Sequence[str], gate: int | None = None) -> DataFrame:
    """Each row of ``base`` with the latest row of ``other`` at its stamp or earlier; null beyond ``gate`` (exclusive)."""
    struct = F.struct(F.col(time).alias("t"), F.col(other_seq).alias("s"), *columns)
    a = base.select(*key, time, F.struct(*base.columns).alias("row"), F.lit(None).cast(other.select(struct.alias("o")).schema["o"].dataType).alias("obs"), F.col(base_seq).alias("seq"), F.lit(1).alias("side"))
    b = other.select(*key, time, F.lit(None).alias("row"), struct.alias("obs"), F.col(other_seq).alias("seq"), F.lit(0).alias("side"))
    before = Window.partitionBy(*key).orderBy(time, "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("found", F.last("obs", ignorenulls=True).over(before)).where("row is not null")
    near = F.col("found").isNotNull() if gate is None else (F.col(time) - F.col("found.t") < gate)
    return found.select("row.*", *[F.when(near, F.col(f"found.{c}")).alias(c) for c in columns])


def nearest_within(base: DataFrame, other: DataFrame, key: Sequence[str], time: str, base_seq: str, other_seq: str, gate: int) -> DataFrame:
    """(base row, other_seq, dt) for the row of ``other`` nearest in time, at most ``gate`` away; the earlier sequence on ties.

    One sort of the union: the nearest row is the last one before or the first one after, however many are within the gate.
    """
    seen = other.groupBy(*key, time).agg(F.min(other_seq).alias("s"))  # of rows with one stamp, the earliest sequence
    point = seen.select(*key, time, F.struct(F.col(time).alias("t"), "s").alias("obs"))
    a = base.select(*key, time, F.struct(*base.columns).alias("row"), F.lit(None).cast(point.schema["obs"].dataType).alias("obs"), F.lit(1).alias("side"))
    b = point.select(*key, time, F.lit(None).alias("row"), "obs", F.lit(0).alias("side"))
    ordered = Window.partitionBy(*key).orderBy(time, "side")
    met = a.unionByName(b).withColumns(
        {
            "before": F.last("obs", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.first("obs", ignorenulls=True).over(ordered.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col(time)).alias("dt"), F.col(f"{c}.s").alias("s")))
    best = F.least(away("before"), away("after"))  # nulls are passed over
    found = met.where("row is not null").withColumn("best", best).where(F.col("best.dt") <= gate)
    return found.select("row.*", F.col("best.s").alias("other_seq"), F.col("best.dt").alias("dt"))


def next_at_or_after(base: DataFrame, other: DataFrame, key: Sequence[str], time: str, base_seq: str, other_seq: str) -> DataFrame:
    """Each row of ``base`` with the first row of ``other`` at its stamp or later, as other_seq; null after the last."""
    a = base.select(*key, time, F.struct(*base.columns).alias("row"), F.lit(None).cast(other.schema[other_seq].dataType).alias("obs"), F.col(base_seq).alias("seq"), F.lit(0).alias("side"))
    b = other.select(*key, time, F.lit(None).alias("row"), F.col(other_seq).alias("obs"), F.col(other_seq).alias("seq"), F.lit(1).alias("side"))
    ahead = Window.partitionBy(*key).orderBy(time, "side", "seq").rowsBetween(1, Window.unboundedFollowing)
    return a.unionByName(b).withColumn("other_seq", F.first("obs", ignorenulls=True).over(ahead)).where("row is not null").select("row.*", "other_seq")


def with_first_info(frames: DataFrame, info: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], buffer: int = 64) -> DataFrame:
    """``frames`` with the first ``info`` row of their key, for the whole stream.

    Frames that come before it wait for it, ``buffer`` of them at most, the first ones; later ones before it are lost, as are
    all of a key without info.
    """
    place = F.struct(*order)
    first = info.groupBy(*key).agg(F.min_by(F.struct(place.alias("__at"), *columns), place).alias("__i"))
    met = frames.join(first, list(key)).withColumn("__early", place < F.col("__i.__at"))
    rank = F.row_number().over(Window.partitionBy(*key, "__early").orderBy(*order))
    return met.withColumn("__n", rank).where(~F.col("__early") | (F.col("__n") <= buffer)).select(*frames.columns, *[F.col(f"__i.{c}").alias(c) for c in columns])


def predicted(df: DataFrame, key: Sequence[str], time: str, order: Sequence[str], x: str, y: str, theta: str, most: float = 4.0) -> DataFrame:
    """Planar poses with what constant velocity predicts for each from the two before it, as qx, qy, qtheta.

    The last motion is scaled by the ratio of the times, between 0 and ``most``. Where there was no motion yet, or no time
    passed, the prediction is the pose before; first rows have none.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    lag = lambda c, n: F.lag(c, n).over(w)
    names = {f"__{c}{n}": lag(c, n) for c in (x, y, theta, time) for n in (1, 2)}
    d = df.withColumns(names)
    v = lambda c, n: F.col(f"__{c}{n}")
    dt, before = (F.col(time) - v(time, 1)) * 1e-9, (v(time, 1) - v(time, 2)) * 1e-9
    k = F.when((before > 1e-6) & (dt > 0), F.least(F.greatest(dt / before, F.lit(0.0)), F.lit(most))).otherwise(0.0)
    c2, s2, c1, s1 = F.cos(v(theta, 2)), F.sin(v(theta, 2)), F.cos(v(theta, 1)), F.sin(v(theta, 1))
    mx, my = v(x, 1) - v(x, 2), v(y, 1) - v(y, 2)
    d = d.withColumns({"__k": k, "__fx": c2 * mx + s2 * my, "__fy": c2 * my - s2 * mx, "__ft": wrap_angle(v(theta, 1) - v(theta, 2))})
    step = lambda n: F.coalesce(F.col(n) * F.col("__k"), F.when(v(x, 1).isNotNull(), 0.0))
    out = {"qx": v(x, 1) + c1 * step("__fx") - s1 * step("__fy"), "qy": v(y, 1) + s1 * step("__fx") + c1 * step("__fy"), "qtheta": wrap_angle(v(theta, 1) + step("__ft"))}
    return d.withColumns(out).drop(*names, "__k", "__fx", "__fy", "__ft")


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in key]
    found = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return found.select(*key, "r.*")


def every_nth(df: DataFrame, n: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows number 0, n, 2n ... of each key."""
    return numbered(df, key, order, "pos").where((F.col("pos") - 1) % n == 0).drop("pos")


def on_change(df: DataFrame, column: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` differs from the row before; first rows stay."""
    before = F.lag(column).over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col(column))).drop("__before")


def sortedness(df: DataFrame, key: Sequence[str], time: str, order: Sequence[str]) -> DataFrame:
    """(key, is_sorted): whether stamps never go back in the given order."""
    before = F.lag(time).over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__before", before).groupBy(*key).agg(F.bool_and(F.col("__before").isNull() | (F.col("__before") <= F.col(time))).alias("is_sorted"))


def path_length(df: DataFrame, key: Sequence[str], order: Sequence[str], xyz: Sequence[str], out: str = "length") -> DataFrame:
    """(key, length): sum of the distances between consecutive rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    step = F.sqrt(sum((F.col(c) - F.lag(c).over(w)) ** 2 for c in xyz))
    return df.withColumn("__step", F.coalesce(step, F.lit(0.0))).groupBy(*key).agg(F.sum("__step").alias(out))


def finite_difference(df: DataFrame, key: Sequence[str], time: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each key's first row: stamp, columns, and their rates of change to the second row; 0 where no time passes."""
    w = Window.partitionBy(*key).orderBy(*order)
    dt = (F.lead(time).over(w) - F.col(time)) * F.lit(1e-9)
    rates = {f"v_{c}": F.when(dt > 0, (F.lead(c).over(w) - F.col(c)) / dt).otherwise(0.0) for c in columns}
    return df.withColumns(rates | {"__n": F.row_number().over(w)}).where("__n = 1").select(*key, time, *columns, *rates)


def reanchored(df: DataFrame, key: Sequence[str], order: Sequence[str], x: str, y: str, theta: str) -> DataFrame:
    """Planar poses relative to the first of their key, as x, y and wrapped angle."""
    w = Window.partitionBy(*key).orderBy(*order)
    x0, y0, t0 = (F.first(c).over(w) for c in (x, y, theta))
    dx, dy, c, s = F.col(x) - x0, F.col(y) - y0, F.cos(t0), F.sin(t0)
    return df.withColumns({"rx": c * dx + s * dy, "ry": c * dy - s * dx, "rtheta": wrap_angle(F.col(theta) - t0)})


def integrated(df: DataFrame, key: Sequence[str], order: Sequence[str], dx: str, dy: str, dtheta: str) -> DataFrame:
    """Planar odometry from relative motions in the body frame: nested running sums instead of a fold."""
    w = Window.partitionBy(*key).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    turned = df.withColumns({"theta": F.sum(dtheta).over(upto), "__t": F.coalesce(F.sum(dtheta).over(before), F.lit(0.0))})
    c, s = F.cos("__t"), F.sin("__t")
    moved = turned.withColumns({"__x": c * F.col(dx) - s * F.col(dy), "__y": s * F.col(dx) + c * F.col(dy)})
    return moved.withColumns({"x": F.sum("__x").over(upto), "y": F.sum("__y").over(upto)}).drop("__t", "__x", "__y")
