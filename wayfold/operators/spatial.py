"""Operators on scans, depth images and points in the plane or in space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geometry import rotate, transform_point, vector
from wayfold.operators.folds import Suppression, folded


def beam_points(scans: DataFrame, ranges: str, angle_min: Column, increment: Column, range_min: Column, range_max: Column, keep: Sequence[str]) -> DataFrame:
    """(keep, beam, r, x, y) for each usable beam: finite and within the limits, which belong to it."""
    beams = scans.select(*keep, angle_min.alias("__a"), increment.alias("__i"), range_min.alias("__lo"), range_max.alias("__hi"), F.posexplode(ranges).alias("beam", "__r"))
    r = F.col("__r").cast("double")
    fine = ~F.isnan(r) & (F.abs(r) < float("inf")) & (r >= F.col("__lo")) & (r <= F.col("__hi"))
    angle = F.col("__a") + F.col("beam") * F.col("__i")
    return beams.where(fine).select(*keep, "beam", r.alias("r"), (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


def stride_for(depth: Column, fx: Column, spacing: float, base: int) -> Column:
    """The largest base * 2**j that is at most max(spacing * fx / depth, base)."""
    times = F.greatest(F.lit(spacing) * fx / depth / base, F.lit(1.0))
    near = F.pow(F.lit(2.0), F.floor(F.log2(times)))
    # the logarithm may be a rounding off at whole powers
    power = F.when(near > times, near / 2).when(2 * near <= times, 2 * near).otherwise(near)
    return (base * power).cast("long")


def back_project(pixels: DataFrame, u: str, v: str, z: str, k: dict[str, float], near: float, far: float, spacing: float, base: int) -> DataFrame:
    """Pinhole points of the pixels within range that lie on the grid for their depth: near surfaces are thinned more."""
    stride = stride_for(F.col(z), F.lit(k["fx"]), spacing, base)
    kept = pixels.where((F.col(z) >= near) & (F.col(z) <= far)).withColumn("stride", stride)
    kept = kept.where((F.col(u) % F.col("stride") == 0) & (F.col(v) % F.col("stride") == 0))
    return kept.withColumns({"x": (F.col(u) - k["cx"]) * F.col(z) / k["fx"], "y": (F.col(v) - k["cy"]) * F.col(z) / k["fy"]})


def nearest_in_grid(points: DataFrame, references: DataFrame, point_id: str, reference_id: str, gate: float, k: int = 2, key: Sequence[str] = ()) -> DataFrame:
    """(key, point_id, reference_id, d2, rank) of the k references nearest to each point, at most ``gate`` away.

    Both tables have x and y. Cells are as wide as the gate, and references are put into the nine cells around
    theirs, so an equality join finds all pairs. Ties go to the smaller reference id.
    """
    cell = lambda c: F.floor(F.col(c) / gate)
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    refs = references.select(*key, reference_id, F.col("x").alias("rx"), F.col("y").alias("ry"), cell("x").alias("cx"), cell("y").alias("cy"))
    refs = refs.withColumn("i", near).withColumn("j", near).select(*key, reference_id, "rx", "ry", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"))
    met = points.select(*key, point_id, "x", "y", cell("x").alias("cx"), cell("y").alias("cy")).join(refs, [*key, "cx", "cy"])
    dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
    rank = F.row_number().over(Window.partitionBy(*key, point_id).orderBy("d2", reference_id))
    found = met.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= gate * gate)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*key, point_id, reference_id, "d2", "rank")


def within_radius(queries: DataFrame, anchors: DataFrame, radius: float, key: Sequence[str] = ()) -> DataFrame:
    """Pairs of a query and an anchor of equal key at most ``radius`` apart, by cells as wide as the radius. Both have x and y."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a = anchors.withColumnsRenamed({"x": "ax", "y": "ay"})
    a = a.withColumn("__i", near).withColumn("__j", near).withColumns({"__cx": F.floor(F.col("ax") / radius) + F.col("__i"), "__cy": F.floor(F.col("ay") / radius) + F.col("__j")})
    met = queries.withColumns({"__cx": cell("x"), "__cy": cell("y")}).join(a.drop("__i", "__j"), [*key, "__cx", "__cy"]).drop("__cx", "__cy")
    return met.withColumn("distance", F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))).where(F.col("distance") <= radius)


def seeds(step: float, turn: float) -> list[tuple[int, float, float, float]]:
    """The 27 starting offsets (number, dx, dy, dtheta) around a candidate."""
    return [(9 * i + 3 * j + k, dx, dy, dt) for i, dx in enumerate((-step, 0.0, step)) for j, dy in enumerate((-step, 0.0, step)) for k, dt in enumerate((-turn, 0.0, turn))]


def ray_circle(ox: Column, oy: Column, dx: Column, dy: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """Distance along a unit ray to a circle: the near hit, or the far one from inside; infinite where it misses."""
    mx, my = ox - cx, oy - cy
    b = mx * dx + my * dy
    disc = b * b - (mx * mx + my * my - radius * radius)
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    miss = F.lit(float("inf"))
    return F.when(disc < 0, miss).when(-b - root > 0, -b - root).when(-b + root > 0, -b + root).otherwise(miss)


def ray_box(ox: Column, oy: Column, dx: Column, dy: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Distance along a unit ray from inside a box to its wall; infinite along an axis that the ray runs parallel to."""
    far = lambda o, d, lo, hi: F.when(d > 0, (F.lit(hi) - o) / d).when(d < 0, (F.lit(lo) - o) / d).otherwise(float("inf"))
    return F.least(far(ox, dx, x0, x1), far(oy, dy, y0, y1))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` that are computed once, however often later ones use them: projections on a generator aren't merged with those below it.

    Merged, steps whose results are used many times multiply: a rotation of a rotation parses its row's text a thousand times.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def lifted(points: DataFrame, extrinsic: Column, tilt: Column, clearance: float | None = None, sensor_z: Column | None = None) -> DataFrame:
    """Sensor points (x, y, z) in the levelled base frame, as px, py, pz: the extrinsic pose, then the tilt rotation (null: not known yet).

    With a ``clearance``, points below it go, as hits of the floor, where the tilt is known and the sensor is more than
    twice as high; without one all stay.
    """
    at = once(points, __at=vector(F.col("x"), F.col("y"), F.col("z")), __tilt=tilt)
    moved = once(at, __base=transform_point(extrinsic, F.col("__at")))
    level = F.when(F.col("__tilt").isNotNull(), rotate(F.col("__tilt"), F.col("__base"))).otherwise(F.col("__base"))
    out = once(moved, __p=level).withColumns({f"p{a}": F.col(f"__p.{a}") for a in "xyz"})
    if clearance is not None:
        out = out.where(~(F.col("__tilt").isNotNull() & (sensor_z > 2 * clearance) & (F.col("pz") < clearance)))
    return out.drop("__at", "__tilt", "__base", "__p")


def in_bands(points: DataFrame, z: str, planes: Sequence[float], tolerance: float) -> DataFrame:
    """Points whose height is at most ``tolerance`` from one of the planes that a laser sweeps."""
    return points.where(F.exists(F.array(*[F.lit(float(p)) for p in planes]), lambda p: F.abs(F.col(z) - p) <= tolerance))


def thinned(points: DataFrame, key: Sequence[str], order: Sequence[str], most: int, up: bool = False) -> DataFrame:
    """Every k-th point of each key, from the first: k is n // most, or n / most rounded up, and 1 at least."""
    n = F.count("*").over(Window.partitionBy(*key))
    step = F.greatest(F.ceil(F.col("__n") / most) if up else F.floor(F.col("__n") / most), F.lit(1).cast("long"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return points.withColumns({"__n": n, "__k": rank}).where(F.col("__k") % step == 0).drop("__n", "__k")


def masked(pixels: DataFrame, mask: DataFrame, u: str, v: str, size: tuple[int, int], mask_size: tuple[int, int], key: Sequence[str] = ()) -> DataFrame:
    """``pixels`` of an image of the given size without those that a mask of another size covers; ``mask`` has (key, mu, mv)."""
    scaled = lambda c, n, m: F.least(F.floor(F.col(c) * m / n), F.lit(m - 1))
    there = pixels.withColumns({"mu": scaled(u, size[0], mask_size[0]), "mv": scaled(v, size[1], mask_size[1])})
    return there.join(mask.select(*key, "mu", "mv").distinct(), [*key, "mu", "mv"], "left_anti").drop("mu", "mv")


def letterbox(width: Column, height: Column, side: int) -> tuple[Column, Column, Column]:
    """(scale, left pad, top pad) that fit an image into a square; pads may end within a pixel."""
    scale = F.least(side / width, side / height)
    return scale, (side - width * scale) / 2, (side - height * scale) / 2


def dilated(pixels: DataFrame, key: Sequence[str], u: str, v: str, radius: int) -> DataFrame:
    """Distinct pixels within a square of the given radius around those given."""
    step = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    wide = pixels.select(*key, u, v).distinct().withColumn("__i", step).withColumn("__j", step)
    return wide.select(*key, (F.col(u) + F.col("__i")).alias(u), (F.col(v) + F.col("__j")).alias(v)).distinct()


def suppressed(boxes: DataFrame, key: Sequence[str], order: Sequence[Column | str], iou: float) -> DataFrame:
    """(key, id, score): greedy suppression per key; boxes (x0, y0, x1, y1, score, id) by falling ``order``, smaller ids first on ties.

    Sequential by nature, so it is an ordered fold, whose rows stream through the task; its state is the boxes kept.
    """
    falling = {f"__o{k}": -F.col(c) if isinstance(c, str) else -c for k, c in enumerate(order)}
    keyed = boxes.select(F.struct(*key).alias("k"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], *[c.alias(n) for n, c in falling.items()])
    return folded(keyed, lambda: Suppression(iou), "k", [*falling, "id"]).select(*[F.col("k").getField(c).alias(c) for c in key], "id", "score")
