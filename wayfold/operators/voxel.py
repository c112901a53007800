"""Sparse voxel maps as tables: one row per voxel, keyed by its index and, for storage, by its block of 8 x 8 x 8."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.spatial import within_radius

AXES = ("x", "y", "z")
#: Cap of a mean from which keys beyond it are few enough to be broadcast.
FEW = 10_000


def index(p: Column | str, voxel: float) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.floor(p / voxel)


def block(i: Column | str) -> Column:
    return F.shiftright(i, 3)


def capped_mean(observations: DataFrame, key: Sequence[str], value: str, cap: int, order: Sequence[str]) -> DataFrame:
    """(key, mean, n): running means whose weight stops at ``cap``, and the number of observations.

    Each observation is added as mean += (value - mean) / (weight + 1), weight = min(weight + 1, cap). So up to cap + 1
    observations it is their plain mean. Every later one shrinks all earlier shares by cap / (cap + 1) and has 1 / (cap + 1)
    itself, which makes a weighted sum; only keys that go beyond the cap are numbered in ``order``.
    """
    sizes = observations.groupBy(*key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    beyond = sizes.where(F.col("n") > cap + 1).select(*[F.col(k).alias(f"__{k}") for k in key], F.col("n").alias("__n"))
    if cap >= FEW:  # at most one key for that many observations: those within their cap are then not shuffled again
        beyond = F.broadcast(beyond)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    numbered = observations.join(beyond, same).withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    share = F.pow(F.lit(cap / (cap + 1)), F.col("__n") - F.greatest("__i", F.lit(cap + 1))) / (cap + 1)
    folded = numbered.groupBy(*key).agg(F.sum(share * F.col(value)).alias("mean"), F.first("__n").alias("n"))
    return sizes.where(F.col("n") <= cap + 1).unionByName(folded)


def fused(observations: DataFrame, key: Sequence[str], value: str = "obs", cap: int = 100_000, order: Sequence[str] = ("stamp_ns", "event_id")) -> DataFrame:
    """(key, tsdf, weight): running means of unit-weight observations, as an ordered fold once a weight has reached the cap."""
    means = capped_mean(observations, key, value, cap, order)
    return means.select(*key, F.col("mean").alias("tsdf"), F.least("n", F.lit(cap).cast("long")).alias("weight"))


def ray_observations(rays: DataFrame, keep: Sequence[str], voxel: float, truncation: float) -> DataFrame:
    """(keep, step, ix, iy, iz, obs) along each ray (ox, oy, oz) -> (px, py, pz), in the band around its end.

    Steps are half a voxel, the last is clamped to the band's end; a voxel that repeats the one before is left out.
    """
    d = {a: F.col(f"p{a}") - F.col(f"o{a}") for a in AXES}
    dist = F.sqrt(sum(v * v for v in d.values()))
    band = rays.withColumn("dist", dist).where("dist >= 1e-9").withColumns(
        {"start": F.greatest(F.col("dist") - truncation, F.lit(0.0)), "end": F.col("dist") + truncation}
    )
    steps = F.floor((F.col("end") - F.col("start")) / (voxel / 2)).cast("int") + 1
    way = lambda step: F.least(F.col("start") + step * (voxel / 2), F.col("end"))
    fresh = stepped(band.withColumn("step", F.explode(F.sequence(F.lit(0), steps))), way, voxel)
    obs = F.greatest(F.lit(-truncation), F.least(F.lit(truncation), F.col("dist") - way(F.col("step"))))
    return fresh.select(*keep, "step", "ix", "iy", "iz", obs.alias("obs"))


def stepped(walked: DataFrame, way: Callable[[Column], Column], voxel: float) -> DataFrame:
    """``walked`` with the voxel ix, iy, iz that each ``step`` of a ray is in, where it isn't that of the step before.

    ``way`` tells how far along the ray a step is. The step before is computed once more rather than looked up, so rays
    are neither shuffled nor sorted. All of its steps before one must be among the rows or in other voxels.
    """
    at = lambda step: {a: index(F.col(f"o{a}") + way(step) * (F.col(f"p{a}") - F.col(f"o{a}")) / F.col("dist"), voxel) for a in AXES}
    here, before = at(F.col("step")), at(F.col("step") - 1)
    moved = [here[a] != before[a] for a in AXES]
    return walked.withColumns({f"i{a}": c for a, c in here.items()}).where((F.col("step") == 0) | moved[0] | moved[1] | moved[2])


def sampled(points: DataFrame, voxels: DataFrame, point_id: str, voxel: float) -> DataFrame:
    """(point_id, sdf) of the points that :func:`gradients` has a value for."""
    return gradients(points, voxels, point_id, voxel).where("sdf is not null").select(point_id, "sdf")


def gradients(points: DataFrame, voxels: DataFrame, point_id: str, voxel: float, key: Sequence[str] = ()) -> DataFrame:
    """(key, point_id, sdf, gx, gy, gz): trilinear value and gradient from the eight voxel centres around each point (x, y, z).

    If only one layer in z is complete, that layer alone counts, the lower first, and the gradient in z is 0. Points without a
    complete layer have nulls. A point reads one row for each voxel around it that is known, so all its sums are of one group.
    """
    grid = {a: F.col(a) / voxel - 0.5 for a in AXES}
    cells = points.select(*key, point_id, *[F.floor(g).alias(f"g{a}") for a, g in grid.items()], *[(g - F.floor(g)).alias(f"f{a}") for a, g in grid.items()])
    corner = F.explode(F.array(*[F.struct(*[F.lit(n >> k & 1).alias(f"b{a}") for k, a in enumerate(AXES)]) for n in range(8)]))
    corners = cells.withColumn("c", corner).withColumns({f"i{a}": F.col(f"g{a}") + F.col(f"c.b{a}") for a in AXES})
    known = corners.join(voxels.where("weight > 0").select(*key, "ix", "iy", "iz", "tsdf"), [*key, "ix", "iy", "iz"], "left")
    side = lambda a: F.when(F.col(f"c.b{a}") == 1, F.col(f"f{a}")).otherwise(1 - F.col(f"f{a}"))
    sign = lambda a: 2 * F.col(f"c.b{a}") - 1
    parts = {"v": side("x") * side("y"), "dx": sign("x") * side("y"), "dy": side("x") * sign("y")}
    sums = [F.sum(F.when(F.col("c.bz") == z, w * F.col("tsdf"))).alias(f"{n}{z}") for n, w in parts.items() for z in (0, 1)]
    full = [F.count_if((F.col("c.bz") == z) & F.col("tsdf").isNotNull()).alias(f"n{z}") for z in (0, 1)]
    found = known.groupBy(*key, point_id).agg(*sums, *full, F.first("fz").alias("fz"))
    lo, hi, fz = F.col("n0") == 4, F.col("n1") == 4, F.col("fz")
    mixed = lambda n: F.when(lo & hi, F.col(f"{n}0") * (1 - fz) + F.col(f"{n}1") * fz).when(lo, F.col(f"{n}0")).when(hi, F.col(f"{n}1"))
    rise = F.when(lo & hi, F.col("v1") - F.col("v0")).when(lo | hi, 0.0)
    return found.select(*key, point_id, mixed("v").alias("sdf"), (mixed("dx") / voxel).alias("gx"), (mixed("dy") / voxel).alias("gy"), (rise / voxel).alias("gz"))


def blocks_allocated(voxels: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(key, voxels): allocated voxels, 512 for each block that holds one."""
    return voxels.select(*key, *(block(f"i{a}").alias(f"b{a}") for a in AXES)).distinct().groupBy(*key).agg((F.count("*") * 512).alias("voxels"))


def surface(voxels: DataFrame, voxel: float) -> DataFrame:
    """Observed voxels nearer to the surface than one voxel."""
    return voxels.where((F.col("weight") > 0) & (F.abs("tsdf") < voxel))


def ghost_fraction(points: DataFrame, key: Sequence[str], walls: tuple[float, float, float, float], clearance: float) -> DataFrame:
    """(key, ghosts): the share of points farther than ``clearance`` from all four walls x0, x1, y0, y1."""
    x0, x1, y0, y1 = walls
    nearest = F.least(F.abs(F.col("x") - x0), F.abs(F.col("x") - x1), F.abs(F.col("y") - y0), F.abs(F.col("y") - y1))
    return points.groupBy(*key).agg(F.avg((nearest > clearance).cast("int")).alias("ghosts"))


def stale_ghosts(points: DataFrame, point_id: str, key: Sequence[str], walls: tuple[float, float, float, float], clearance: float, people: DataFrame, reach: float) -> DataFrame:
    """(key, stale): the share of ghosts (see :func:`ghost_fraction`) that stand ``reach`` or more from every person of ``people`` (x, y)."""
    x0, x1, y0, y1 = walls
    wall = F.least(F.abs(F.col("x") - x0), F.abs(F.col("x") - x1), F.abs(F.col("y") - y0), F.abs(F.col("y") - y1))
    there = points.select(point_id, *key, "x", "y", (wall > clearance).alias("__ghost"))
    met = within_radius(there.where("__ghost").select(point_id, "x", "y"), people.select("x", "y"), reach)
    beside = met.where(F.col("distance") < reach).select(point_id, F.lit(True).alias("__beside")).distinct()
    stale = F.col("__ghost") & F.col("__beside").isNull()
    return there.join(beside, point_id, "left").groupBy(*key).agg(F.avg(stale.cast("int")).alias("stale"))


def mixed_hash(*indices: Column) -> Column:
    """A 64-bit mix of voxel indices, for thinning that doesn't depend on order; additions and shifts only, so no overflow differs."""
    h = F.lit(0).cast("long")
    for i in indices:
        h = F.pmod(h * 31 + F.pmod(i.cast("long"), F.lit(1 << 20).cast("long")) * 2654435, F.lit((1 << 40) - 87).cast("long"))
        h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    return h
