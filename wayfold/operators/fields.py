"""Signed-distance fields as voxel tables that rays are fused into, carved by, and scans registered against."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wayfold.functions.geometry import wrap_angle
from wayfold.operators.folds import OUT
from wayfold.operators.lineage import cut
from wayfold.operators.spatial import within_radius
from wayfold.operators.voxel import AXES, capped_mean, gradients, index, ray_observations, stepped


@dataclass(frozen=True)
class Field:
    """How a field is kept: sizes in metres, the weight's cap, and what a ray that flies on does to voxels on its way."""

    voxel: float = 0.05
    truncation: float = 0.15
    most: float = 64.0
    carve: float = 0.5
    margin: float = 0.1


#: The field that scans are registered against, and the one in space that points are fused into.
REGISTRATION, SPACE = Field(0.025, 0.075, 1e5, 0.7, 0.0), Field(0.05, 0.15, 1e5, 0.5, 0.1)


def carve_events(rays: DataFrame, keep: Sequence[str], field: Field) -> DataFrame:
    """(keep, step, ix, iy, iz) of the voxels that rays (ox, oy, oz) -> (px, py, pz) pass free of any hit.

    The free part ends a truncation and a voxel before the hit. With a margin, only places count that the ray overshoots by
    more than that share of their distance and two truncations: grazing rays don't wear a surface off. Steps are a voxel;
    a voxel that repeats the one before is left out.
    """
    dist = F.sqrt(sum((F.col(f"p{a}") - F.col(f"o{a}")) * (F.col(f"p{a}") - F.col(f"o{a}")) for a in AXES))
    far = rays.withColumn("dist", dist).withColumn("free", F.greatest(F.col("dist") - field.truncation, F.lit(0.0)) - field.voxel)
    far = far.where((F.col("dist") >= 1e-9) & (F.col("free") >= field.voxel))
    way = lambda step: F.least(step * field.voxel, F.col("free"))
    walked = far.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor(F.col("free") / field.voxel).cast("int") + 1)))
    if field.margin:  # this keeps a ray's first steps, so each still has the one before
        s = way(F.col("step"))
        walked = walked.where(F.col("dist") - s > F.greatest(field.margin * s, F.lit(2 * field.truncation)))
    return stepped(walked, way, field.voxel).select(*keep, "step", "ix", "iy", "iz")


class Voxel:
    """One voxel's events in order: observations, and rays that pass it; a voxel that is carved below weight 1 is unobserved again."""

    def __init__(self, most: float, carve: float, channels: Sequence[str] = ("red",), colours: int = 32):
        self.most, self.carve, self.channels, self.colours = most, carve, channels, colours
        self.columns = ", ".join(["tsdf double, weight double", *(f"{c} double" for c in channels), "n_red int, observed long, carved long"])
        self.tsdf, self.weight, self.paint, self.n, self.observed, self.carved = 0.0, 0.0, [0.0] * len(channels), 0, 0, 0

    def passed(self, times: int) -> None:
        """Rays pass the voxel, so many one after another; those that find it unobserved change nothing."""
        while times and self.weight > 0:
            self.weight, self.carved, times = self.weight * self.carve, self.carved + 1, times - 1
            if self.weight < 1:
                self.tsdf = self.weight = 0.0
                self.paint, self.n = [0.0] * len(self.channels), 0

    def seen(self, obs: float, colour: Sequence[float] | None) -> None:
        weight = self.weight
        self.tsdf = (self.tsdf * weight + obs) / (weight + 1)
        self.weight, self.observed = min(weight + 1, self.most), self.observed + 1
        if colour is not None:
            self.paint = [p + (c - p) / (self.n + 1) for p, c in zip(self.paint, colour, strict=True)]
            self.n = min(self.n + 1, self.colours)

    def finish(self) -> dict:
        seen = dict(zip(self.channels, self.paint if self.n else [None] * len(self.channels), strict=True))
        return {"tsdf": self.tsdf, "weight": self.weight, **seen, "n_red": self.n, "observed": self.observed, "carved": self.carved}


def _uncarved(seen: DataFrame, cell: Sequence[str], order: Sequence[str], field: Field, channels: Sequence[str], colours: int = 32) -> DataFrame:
    """What :class:`Voxel` gives for voxels that no ray passes: running means, which are aggregates up to their caps."""
    place = [*order, "step"]
    out = capped_mean(seen, cell, "obs", int(field.most), place).select(*cell, F.col("mean").alias("tsdf"), F.least(F.col("n").cast("double"), F.lit(field.most)).alias("weight"), F.col("n").alias("observed"))
    if not channels:
        return out.select(*cell, "tsdf", "weight", F.lit(None).cast("double").alias("red"), F.lit(0).alias("n_red"), "observed", F.lit(0).cast("long").alias("carved"))
    painted = seen.where("colour is not null")
    for k, name in enumerate(channels):
        mean = capped_mean(painted.withColumn("__c", F.col("colour")[k]), cell, "__c", colours, place)
        out = out.join(mean.select(*cell, F.col("mean").alias(name), *([F.least("n", F.lit(colours)).cast("int").alias("n_red")] if not k else [])), list(cell), "left")
    return out.select(*cell, "tsdf", "weight", *channels, F.coalesce("n_red", F.lit(0)).alias("n_red"), "observed", F.lit(0).cast("long").alias("carved"))


def fused(rays: DataFrame, key: Sequence[str], order: Sequence[str], field: Field, colour: str | Sequence[str] | None = None) -> DataFrame:
    """(key, ix, iy, iz, tsdf, weight, red, n_red, observed, carved): rays fused into a field, one map for each key.

    ``order`` numbers the rays of a key. Each first carves the voxels on its free part, then is observed in the band around
    its hit; the voxel of the hit takes the ``colour``, one column or several channels, which then have a column each in place of red.
    Only voxels that are observed at some time have rows, so rays through empty space meet none; those are semi-joined away before
    anything is sorted. Without carving voxels are aggregates; with it a voxel's events are folded in order.
    """
    names, cell = [*key, *order], [*key, "ix", "iy", "iz"]
    channels = [colour] if isinstance(colour, str) else list(colour or ())
    shown = ["red"] if len(channels) < 2 else channels
    if channels:
        rays = rays.withColumns({"colour": F.array(*[F.col(c).cast("double") for c in channels]), **{f"h{a}": index(f"p{a}", field.voxel) for a in AXES}})
    seen = ray_observations(rays, [*names, *(("colour", "hx", "hy", "hz") if channels else ())], field.voxel, field.truncation)
    if not channels:
        seen = seen.withColumn("colour", F.lit(None).cast("array<double>"))
    else:
        known = F.forall("colour", lambda c: c.isNotNull())
        # a straight ray meets the voxel of its hit once
        seen = seen.withColumn("colour", F.when(known & (F.col("ix") == F.col("hx")) & (F.col("iy") == F.col("hy")) & (F.col("iz") == F.col("hz")), F.col("colour")))
    seen = seen.select(*cell, *order, "step", "obs", "colour")
    if field.carve >= 1:
        return _uncarved(seen, cell, order, field, shown if channels else ())
    passed = carve_events(rays, names, field).join(seen.select(*cell).distinct(), cell, "left_semi")
    nothing = F.lit(None).cast("double").alias("obs"), F.lit(None).cast("array<double>").alias("colour")
    events = seen.select(*cell, *order, "obs", "colour").unionByName(passed.select(*cell, *order, *nothing))
    return _carved(events, cell, order, field, shown)


def _carved(events: DataFrame, cell: Sequence[str], order: Sequence[str], field: Field, channels: Sequence[str]) -> DataFrame:
    """What :class:`Voxel` gives for each cell of ``events`` (cell, order, obs, colour), in order; where ``obs`` is null a ray passes.

    A ray passes a voxel and is observed in it once each, so nulls come first of its events. Passes that follow each other are one
    step with their number.
    """
    make = lambda: Voxel(field.most, field.carve, channels)
    schema = StructType([*events.select(*cell).schema.fields, *StructType.fromDDL(make().columns).fields])
    arrow = to_arrow_schema(schema)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            obs = batch.column("obs").to_numpy(zero_copy_only=False)
            passed = np.isnan(obs)
            fresh = np.zeros(len(obs), bool)
            for c in cell:
                number = batch.column(c).dictionary_encode("encode").indices.to_numpy()
                fresh[1:] |= number[1:] != number[:-1]
            fresh[0] = state is None or at != tuple(batch.column(c)[0].as_py() for c in cell)
            begin = np.flatnonzero(fresh | ~passed | np.append(True, ~passed[:-1]))
            times = np.diff(np.append(begin, len(obs)))
            colours = batch.column("colour").take(pa.array(begin)).to_pylist()
            for k, new, free, times, value, colour in zip(begin.tolist(), fresh[begin].tolist(), passed[begin].tolist(), times.tolist(), obs[begin].tolist(), colours, strict=True):
                if new:
                    if state is not None:
                        yield dict(zip(cell, at, strict=True)) | state.finish()
                    at, state = tuple(batch.column(c)[k].as_py() for c in cell), make()
                if free:
                    state.passed(times)
                else:
                    state.seen(value, colour)
        if state is not None:
            yield dict(zip(cell, at, strict=True)) | state.finish()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = runs(batches)
        while rows := list(islice(found, OUT)):
            yield pa.RecordBatch.from_pylist(rows, arrow)

    sorted_events = events.repartition(*cell).sortWithinPartitions(*cell, *order, "obs")
    return sorted_events.select(*cell, "obs", "colour").mapInArrow(fold, schema)


def plain(observations: DataFrame, key: Sequence[str], field: Field, order: Sequence[str]) -> DataFrame:
    """(key, tsdf, weight) without carving: a running mean, which needs no order until a weight reaches the cap."""
    m = capped_mean(observations, key, "obs", int(field.most), order)
    return m.select(*key, F.col("mean").alias("tsdf"), F.least("n", F.lit(int(field.most)).cast("long")).alias("weight"))


def register(points: DataFrame, voxels: DataFrame, starts: DataFrame, key: Sequence[str], solve: str, field: Field, rounds: int = 12, least: int = 50, flat: bool = True) -> DataFrame:
    """(key, solve, x, y, theta, inliers): planar poses at which the field is smallest along the points, by Gauss-Newton.

    ``points`` has (key, ``solve``'s point rows: pid, x, y, z), ``voxels`` (key, ix, iy, iz, tsdf, weight), ``starts``
    (key, solve, x, y, theta). All solves of all maps take a round together: points meet the voxels around them in one join,
    nine sums of each solve are aggregated, and a closed-form 3 x 3 solution moves its pose. Points farther from the surface than
    0.9 truncations do not count; a solve with fewer than ``least`` of them, or without a solution, keeps its pose. Rounds
    end when no pose moves; each is written to the checkpoint folder, so plans do not grow.
    """
    band, names = 0.9 * field.truncation, [*key, solve]
    poses = starts.select(*names, "x", "y", "theta", F.lit(0.0).alias("inliers"))
    for _ in range(rounds):
        c, s = F.cos("theta"), F.sin("theta")
        at = points.withColumnsRenamed({"x": "bx", "y": "by"}).join(poses.select(*names, "x", "y", "theta"), names)
        moved = at.select(*names, "pid", (c * F.col("bx") - s * F.col("by") + F.col("x")).alias("x"), (s * F.col("bx") + c * F.col("by") + F.col("y")).alias("y"), (F.lit(0.0) if flat else F.col("z")).alias("z"))
        moved = moved.withColumn("id", F.struct(solve, "pid"))
        found = gradients(moved, voxels, "id", field.voxel, key).join(moved.select(*key, "id", "x", "y"), [*key, "id"]).withColumn(solve, F.col(f"id.{solve}"))
        j = [F.col("gx"), F.col("gy"), F.col("gy") * F.col("x") - F.col("gx") * F.col("y")]
        near = F.abs("sdf") <= band
        sums = [F.sum(F.when(near, j[a] * j[b])).alias(f"h{a}{b}") for a in range(3) for b in range(a, 3)] + [F.sum(F.when(near, -j[a] * F.col("sdf"))).alias(f"g{a}") for a in range(3)]
        of = found.groupBy(*names).agg(*sums, F.count_if(near).alias("used"), F.count("*").alias("n"))
        new = cut(poses.drop("inliers").join(of, names, "left").select(*names, *_stepped(least), *[F.col(c).alias(f"__{c}") for c in ("x", "y", "theta")]))
        moved = (F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")) >= 1e-6) | (F.abs(wrap_angle(F.col("theta") - F.col("__theta"))) >= 1e-7)
        poses = new.select(*names, "x", "y", "theta", "inliers")
        if new.where(moved).isEmpty():
            break
    return poses


def _stepped(least: int) -> list[Column]:
    """x, y, theta, inliers after one step, from the sums: by cofactors, as the matrix is symmetric and small."""
    h = lambda a, b: F.col(f"h{min(a, b)}{max(a, b)}")
    minor = lambda a, b: h((a + 1) % 3, (b + 1) % 3) * h((a + 2) % 3, (b + 2) % 3) - h((a + 1) % 3, (b + 2) % 3) * h((a + 2) % 3, (b + 1) % 3)
    det = sum(h(0, b) * minor(0, b) for b in range(3))
    fine = (F.col("used") >= least) & (det > 1e-12) & (minor(2, 2) > 0) & (h(0, 0) > 0)
    step = [F.when(fine, sum(minor(a, b) * F.col(f"g{b}") for b in range(3)) / det).otherwise(0.0) for a in range(3)]
    c, s = F.cos(step[2]), F.sin(step[2])
    x = step[0] + c * F.col("x") - s * F.col("y")
    y = step[1] + s * F.col("x") + c * F.col("y")
    return [x.alias("x"), y.alias("y"), wrap_angle(F.col("theta") + step[2]).alias("theta"), F.coalesce(F.col("used") / F.col("n"), F.lit(0.0)).alias("inliers")]


def loop_closures(scans: DataFrame, points: DataFrame, anchors: DataFrame, voxels: DataFrame, field: Field, radius: float = 12.0, reach: float = 0.5, turn: float = 0.12, accept: float = 0.55, rounds: int = 12) -> DataFrame:
    """(scan, submap, seed, x, y, theta, inliers): for each scan the submap that it closes a loop with, if one does.

    ``scans`` (scan, x, y, theta) and ``anchors`` (submap, x, y, theta) are world poses, ``points`` (scan, pid, x, y, z) in the
    scan's frame, ``voxels`` (submap, ix, iy, iz, tsdf, weight) in the anchor's. Submaps whose anchor is within the radius are tried
    from 27 seeds, all at once; of those with enough inliers the best one holds, of equal ones the first submap, then seed. The
    pose is that of the scan in the submap.
    """
    near = within_radius(scans.select("scan", "x", "y", "theta"), anchors.select("submap", "x", "y", F.col("theta").alias("atheta")), radius)
    grid = [F.struct(F.lit(9 * i + 3 * j + k).alias("seed"), F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(t).alias("dt")) for i, a in enumerate((-reach, 0.0, reach)) for j, b in enumerate((-reach, 0.0, reach)) for k, t in enumerate((-turn, 0.0, turn))]
    tried = near.withColumn("s", F.explode(F.array(*grid)))
    c, s, dx, dy = F.cos("atheta"), F.sin("atheta"), F.col("x") + F.col("s.dx") - F.col("ax"), F.col("y") + F.col("s.dy") - F.col("ay")
    starts = tried.select("submap", F.struct("scan", F.col("s.seed").alias("seed")).alias("solve"), (c * dx + s * dy).alias("x"), (c * dy - s * dx).alias("y"), wrap_angle(F.col("theta") + F.col("s.dt") - F.col("atheta")).alias("theta"))
    rows = starts.select("submap", "solve", F.col("solve.scan").alias("scan")).join(points, "scan").drop("scan")
    found = register(rows, voxels, starts, ["submap"], "solve", field, rounds, least=20)
    best = Window.partitionBy("scan").orderBy(F.desc(F.round("inliers", 9)), "submap", "seed")
    ranked = found.where(F.col("inliers") >= accept).select(F.col("solve.scan").alias("scan"), "submap", F.col("solve.seed").alias("seed"), "x", "y", "theta", "inliers")
    return ranked.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


class Preintegration:
    """Motion between two poses from inertial samples alone: rotation, velocity and position changes in the first one's frame."""

    columns = "stamp_ns long, dt double, vx double, vy double, vz double, px double, py double, pz double, qx double, qy double, qz double, qw double"

    def __init__(self):
        from wayfold.operators import folds

        self.f, self.last, self.t = folds, None, 0.0
        self.q, self.v, self.p = (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)

    def step(self, row) -> dict:
        dt = 0.0 if self.last is None else (row["stamp_ns"] - self.last) * 1e-9
        self.last = row["stamp_ns"]
        if dt > 0:
            a = self.f.turned(self.q, (row["ax"], row["ay"], row["az"]))
            self.p = tuple(p + v * dt + f * dt * dt / 2 for p, v, f in zip(self.p, self.v, a, strict=True))
            self.v = tuple(v + f * dt for v, f in zip(self.v, a, strict=True))
            q = self.f.product(self.q, self.f.rotation(row["gx"] * dt, row["gy"] * dt, row["gz"] * dt))
            size = math.sqrt(sum(c * c for c in q))
            self.q, self.t = tuple(c / size for c in q), self.t + dt
        names = [c.split()[0] for c in self.columns.split(", ")]
        return dict(zip(names, (row["stamp_ns"], self.t, *self.v, *self.p, *self.q), strict=True))
