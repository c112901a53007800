"""Maps in submaps: which poses are fused, into which submaps, and where those stand in the world.

The order of a run matters only for what is decided pose by pose: whether a pose is fused, and when a submap hands over to
the next one. That is one fold with a state of a few numbers. Everything else is relational: an observation fans out to its submap
and, while two overlap, to the one before; its rays are expressed in the submaps' anchors, fused by submap, and a submap is moved
by giving its anchor another pose, which never rewrites a voxel.

Poses are planar (x, y, theta); points are (px, py, pz) in the levelled base frame, seen from (ox, oy, oz) in it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geometry import wrap_angle
from wayfold.operators import fields, graphs, registration
from wayfold.operators.folds import folded
from wayfold.operators.spatial import in_bands


@dataclass(frozen=True)
class Mapping:
    """When poses are fused and submaps hand over: metres, radians, metres travelled, fusions that go into both."""

    move: float = 0.1
    turn: float = 0.1
    extent: float = 20.0
    overlap: int = 40


class Fusion:
    """Gates a run's poses by motion, each ``kind`` of sensor for itself, and numbers its submaps.

    The first pose of a kind is fused, then each that is farther than ``move`` or ``turn`` from the kind's last fused one. A fused pose goes
    into the current submap and, while the overlap lasts, into the one before (``also``); ``left`` such fusions are to come. After a fusion, once more than
    ``extent`` has been travelled and no overlap runs, the pose becomes the anchor of a new submap (``spawned``).
    """

    columns = "stamp_ns long, seq long, kind string, x double, y double, theta double, fused boolean, submap int, also int, spawned int, left int, travelled double"

    def __init__(self, cfg: Mapping = Mapping()):
        self.cfg, self.before, self.fusions = cfg, None, {}
        self.submap, self.travelled, self.left = 0, 0.0, 0

    def _due(self, kind: str, pose: tuple[float, float, float]) -> bool:
        last = self.fusions.get(kind)
        if last is None:
            return True
        turn = abs((pose[2] - last[2] + math.pi) % (2 * math.pi) - math.pi)
        return math.hypot(pose[0] - last[0], pose[1] - last[1]) > self.cfg.move or turn > self.cfg.turn

    def step(self, row) -> dict:
        pose = row["x"], row["y"], row["theta"]
        if self.before is not None:
            self.travelled += math.hypot(pose[0] - self.before[0], pose[1] - self.before[1])
        self.before = pose
        out = {"stamp_ns": row["stamp_ns"], "seq": row["seq"], "kind": row["kind"], "x": pose[0], "y": pose[1], "theta": pose[2], "travelled": self.travelled}
        out |= {"fused": self._due(row["kind"], pose), "submap": self.submap, "also": self.submap - 1 if self.left else None, "spawned": None}
        if out["fused"]:
            self.fusions[row["kind"]] = pose
            self.left = max(self.left - 1, 0)
            if self.travelled > self.cfg.extent and not self.left:
                self.submap, self.travelled, self.left = self.submap + 1, 0.0, self.cfg.overlap
                out["spawned"] = self.submap
        return out | {"left": self.left}


def fusions(poses: DataFrame, key: str, cfg: Mapping = Mapping()) -> DataFrame:
    """(key, stamp_ns, seq, kind, x, y, theta, fused, submap, also, spawned, left, travelled) of ``poses`` (key, stamp_ns, seq, kind, x, y, theta)."""
    return folded(poses, lambda: Fusion(cfg), key, ["stamp_ns", "seq"])


def anchors(events: DataFrame, key: str) -> DataFrame:
    """(key, submap, seq, x, y, theta): where each submap of ``events`` (see :func:`fusions`) was begun; the first one at the first pose."""
    first = events.groupBy(key).agg(F.min_by(F.struct("seq", "x", "y", "theta"), F.struct("stamp_ns", "seq")).alias("a")).select(key, F.lit(0).alias("submap"), "a.*")
    return first.unionByName(events.where("spawned is not null").select(key, F.col("spawned").alias("submap"), "seq", "x", "y", "theta"))


def relative(fx: Column, fy: Column, ft: Column, x: Column, y: Column, theta: Column) -> list[Column]:
    """The pose (x, y, theta) as seen from the pose (fx, fy, ft)."""
    c, s = F.cos(ft), F.sin(ft)
    return [c * (x - fx) + s * (y - fy), c * (y - fy) - s * (x - fx), wrap_angle(theta - ft)]


def composed(fx: Column, fy: Column, ft: Column, x: Column, y: Column, theta: Column) -> list[Column]:
    """The pose (x, y, theta), told in the frame of the pose (fx, fy, ft), in the frame of that one."""
    c, s = F.cos(ft), F.sin(ft)
    return [fx + c * x - s * y, fy + s * x + c * y, wrap_angle(ft + theta)]


def hand_over_edges(anchors: DataFrame, key: str) -> DataFrame:
    """(key, from, to, dx, dy, dtheta): the motion from each anchor to the next, as it was when the submap was handed over."""
    w = Window.partitionBy(key).orderBy("submap")
    before = anchors.withColumns({f"__{c}": F.lag(c).over(w) for c in ("submap", "x", "y", "theta")}).where("__submap is not null")
    names = ("__x", "__y", "__theta", "x", "y", "theta")
    return before.select(key, F.col("__submap").alias("from"), F.col("submap").alias("to"), *[c.alias(n) for c, n in zip(relative(*map(F.col, names)), ("dx", "dy", "dtheta"), strict=True)])


def written(events: DataFrame, key: str) -> DataFrame:
    """(key, seq, kind, x, y, theta, submap): one row for each submap that a fused pose is written to."""
    both = F.explode(F.filter(F.array("submap", "also"), lambda s: s.isNotNull()))
    return events.where("fused").select(key, "seq", "kind", "x", "y", "theta", both.alias("submap"))


def local_rays(points: DataFrame, events: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """``points`` (key, seq, pid, ox, oy, oz, px, py, pz, ...) fanned out to the submaps of their pose, as rays in the anchors' frames.

    Each row gets ``submap`` and ``kind``; origin and point are moved, the height stays. Points of poses that aren't fused go.
    """
    at = anchors.select(key, "submap", *[F.col(c).alias(f"__a{c}") for c in ("x", "y", "theta")])
    local = relative(*map(F.col, ("__ax", "__ay", "__atheta", "x", "y", "theta")))
    poses = written(events, key).join(at, [key, "submap"]).select(key, "seq", "kind", "submap", *[c.alias(n) for c, n in zip(local, ("__x", "__y", "__t"), strict=True)])
    met = points.join(poses, [key, "seq"]).withColumns({"__c": F.cos("__t"), "__s": F.sin("__t")})
    for a in "op":
        x, y = F.col(f"{a}x"), F.col(f"{a}y")
        met = met.withColumns({f"{a}x": F.col("__x") + F.col("__c") * x - F.col("__s") * y, f"{a}y": F.col("__y") + F.col("__s") * x + F.col("__c") * y})
    return met.drop("__x", "__y", "__t", "__c", "__s")


def flattened(rays: DataFrame, clearance: float, gated: Column, planes: Sequence[float] = (), tolerance: float = 0.05) -> DataFrame:
    """What of ``rays`` measures the slice that scans are matched in, put into the plane z = 0.

    A scan gives all points but hits of the floor, which are those below ``clearance`` where ``gated`` says that the floor can be
    told; a cloud gives the points in the band of a plane that a laser sweeps.
    """
    scans = rays.where((F.col("kind") == "scan") & ~(gated & (F.col("pz") < clearance)))
    clouds = in_bands(rays.where(F.col("kind") != "scan"), "pz", planes, tolerance) if planes else rays.where(F.lit(False))
    return scans.unionByName(clouds).withColumns({"oz": F.lit(0.0), "pz": F.lit(0.0)})


def integrated(rays: DataFrame, key: str, field: fields.Field, order: Sequence[str] = ("seq", "pid"), colour: str | None = None) -> DataFrame:
    """(key, submap, ix, iy, iz, tsdf, weight, ...): ``rays`` fused into a field for each submap, in the anchors' frames."""
    return fields.fused(rays, [key, "submap"], order, field, colour)


def dual(points: DataFrame, events: DataFrame, key: str, space: fields.Field = fields.SPACE, plane: fields.Field = fields.REGISTRATION, clearance: float = 0.15, gated: Column | None = None, planes: Sequence[float] = (), colour: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors, map in space, map in the plane) of ``points`` seen from the poses of ``events``.

    Both maps take every fused observation into its submap and into the one before while they overlap; the one in space takes all points, the
    one in the plane what :func:`flattened` leaves.
    """
    at = anchors(events, key)
    rays = local_rays(points, events, at, key)
    flat = flattened(rays, clearance, F.lit(False) if gated is None else gated, planes)
    return at, integrated(rays, key, space, colour=colour), integrated(flat, key, plane)


def states(events: DataFrame, key: str) -> DataFrame:
    """(key, submap, state) after all of ``events``: active, overlap (the one before it while both are written to) or frozen."""
    last = events.groupBy(key).agg(F.max_by(F.struct("submap", "spawned", "left"), F.struct("stamp_ns", "seq")).alias("l"))
    now = last.select(key, F.coalesce("l.spawned", "l.submap").alias("active"), F.col("l.left").alias("left"))
    every = now.withColumn("submap", F.explode(F.sequence(F.lit(0), F.col("active"))))  # numbered without gaps
    overlapping = (F.col("submap") == F.col("active") - 1) & (F.col("left") > 0)
    return every.select(key, "submap", F.when(F.col("submap") == F.col("active"), "active").when(overlapping, "overlap").otherwise("frozen").alias("state"))


def placed(voxels: DataFrame, anchors: DataFrame, key: str, voxel: float, base: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """``voxels`` (key, submap, ix, iy, iz, ...) with the centre of each in the world, as wx, wy, wz.

    The anchors are those of now: the ones submaps were begun at, or the ones a pose graph has moved. ``base`` is where the run
    itself began in the world.
    """
    world = composed(*map(F.lit, base), F.col("x"), F.col("y"), F.col("theta"))
    at = anchors.select(key, "submap", *[c.alias(n) for c, n in zip(world, ("__x", "__y", "__t"), strict=True)])
    centre = {a: (F.col(f"i{a}") + 0.5) * voxel for a in "xyz"}
    c, s = F.cos("__t"), F.sin("__t")
    out = {"wx": F.col("__x") + c * centre["x"] - s * centre["y"], "wy": F.col("__y") + s * centre["x"] + c * centre["y"], "wz": centre["z"]}
    return voxels.join(at, [key, "submap"]).withColumns(out).drop("__x", "__y", "__t")


def reposed(anchors: DataFrame, moved: DataFrame, key: str) -> DataFrame:
    """``anchors`` with the poses of ``moved`` (key, node, x, y, theta) where it has any: nodes are submaps."""
    new = moved.select(key, F.col("node").alias("submap"), *[F.col(c).alias(f"__{c}") for c in ("x", "y", "theta")])
    met = anchors.join(new, [key, "submap"], "left")
    return met.withColumns({c: F.coalesce(f"__{c}", c) for c in ("x", "y", "theta")}).drop("__x", "__y", "__theta")


def carried(poses: DataFrame, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``poses`` (key, submap, x, y, theta, ...) as they are once the anchors ``old`` have become ``new``: each stays where it was in its submap."""
    both = old.select(key, "submap", *[F.col(c).alias(f"__o{c}") for c in ("x", "y", "theta")]).join(new.select(key, "submap", *[F.col(c).alias(f"__n{c}") for c in ("x", "y", "theta")]), [key, "submap"])
    met = poses.join(both, [key, "submap"])
    inside = relative(*map(F.col, ("__ox", "__oy", "__otheta", "x", "y", "theta")))
    met = met.withColumns({n: c for c, n in zip(inside, ("__lx", "__ly", "__lt"), strict=True)})
    world = composed(*map(F.col, ("__nx", "__ny", "__ntheta", "__lx", "__ly", "__lt")))
    out = met.withColumns({n: c for c, n in zip(world, ("__wx", "__wy", "__wt"), strict=True)}).withColumns({"x": F.col("__wx"), "y": F.col("__wy"), "theta": F.col("__wt")})
    return out.select(poses.columns)


#: Standard deviations (turn, move) of the motion between submaps and of verified loops.
ODOMETRY, LOOP = (0.05, 0.20), (0.01, 0.05)
Solver = Callable[[DataFrame, DataFrame, str], DataFrame]


def solved(anchors: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, node, x, y, theta): anchors (key, node, x, y, theta) at the optimum of :func:`graphs.planar`."""
    found = graphs.planar(anchors, edges, key).variables
    kinds = anchors.schema[key].dataType, anchors.schema["node"].dataType
    return found.select(F.col("graph").cast(kinds[0]).alias(key), F.col("v").cast(kinds[1]).alias("node"), *[F.col("value")[k].alias(c) for k, c in enumerate(("x", "y", "theta"))])


#: Nodes up to which a graph is solved in one task, by dense equations.
SMALL = 300


def solved_by_size(anchors: DataFrame, edges: DataFrame, key: str, most: int = SMALL) -> DataFrame:
    """What :func:`solved` gives: graphs of at most ``most`` nodes each in a task, larger ones together as sparse equations.

    Dense equations take a graph's nodes squared in memory and cubed in time.
    """
    large = anchors.groupBy(key).count().where(F.col("count") > most).select(key)
    part = lambda how: (anchors.join(large, key, how), edges.join(large, key, how))
    small = registration.optimised(*part("left_anti"), key)
    if large.isEmpty():
        return small
    found = solved(*part("left_semi"), key)
    return small.unionByName(found.withColumn("node", F.col("node").cast("int")))


def closure_edges(closures: DataFrame, events: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, from, to, dx, dy, dtheta): what each of ``closures`` says about the anchor of its submap and that of the submap its pose was in.

    ``closures`` has (key, seq, target, cx, cy, ctheta), the verified pose of an event in the target submap.
    """
    at = anchors.select(key, "submap", *[F.col(c).alias(f"__a{c}") for c in ("x", "y", "theta")])
    met = closures.join(events.select(key, "seq", "submap", "x", "y", "theta"), [key, "seq"]).join(at, [key, "submap"])
    # the active anchor in the event's frame, then in the target's
    back = relative(*map(F.col, ("x", "y", "theta", "__ax", "__ay", "__atheta")))
    met = met.withColumns({n: c for c, n in zip(back, ("__bx", "__by", "__bt"), strict=True)})
    edge = composed(*map(F.col, ("cx", "cy", "ctheta", "__bx", "__by", "__bt")))
    return met.where(F.col("target") != F.col("submap")).select(key, F.col("target").alias("from"), F.col("submap").alias("to"), *[c.alias(n) for c, n in zip(edge, ("dx", "dy", "dtheta"), strict=True)])


def closed(closures: DataFrame, events: DataFrame, anchors: DataFrame, key: str, solve: Solver | None = solved) -> tuple[DataFrame, DataFrame]:
    """(anchors, poses) after loops were closed: ``anchors`` and ``events`` with the poses that the verified ``closures`` lead to.

    Closures of events that no overlap runs at become edges beside the motions between anchors; the graph's optimum moves the
    anchors, and poses go with that of their submap. A pose that closed a loop is where its closure says, in the target submap as it
    is then. Without a solver, for runs without such a closure, and where solving fails, anchors stay and only those poses snap.
    """
    new = anchors
    if solve is not None:
        lone = closures.join(events.where("also is null").select(key, "seq"), [key, "seq"], "left_semi")
        loops = closure_edges(lone, events, anchors, key).withColumns({"sigma_turn": F.lit(LOOP[0]), "sigma_move": F.lit(LOOP[1])})
        hops = hand_over_edges(anchors, key).join(loops.select(key).distinct(), key, "left_semi").withColumns({"sigma_turn": F.lit(ODOMETRY[0]), "sigma_move": F.lit(ODOMETRY[1])})
        nodes = anchors.join(loops.select(key).distinct(), key, "left_semi").select(key, F.col("submap").alias("node"), "x", "y", "theta")
        new = reposed(anchors, solve(nodes, hops.unionByName(loops), key), key)
    moved = carried(events, anchors, new, key)
    at = new.select(key, F.col("submap").alias("target"), *[F.col(c).alias(f"__a{c}") for c in ("x", "y", "theta")])
    snapped = composed(*map(F.col, ("__ax", "__ay", "__atheta", "cx", "cy", "ctheta")))
    there = closures.join(at, [key, "target"]).select(key, "seq", *[c.alias(n) for c, n in zip(snapped, ("__sx", "__sy", "__st"), strict=True)])
    met = moved.join(there, [key, "seq"], "left").withColumns({"x": F.coalesce("__sx", "x"), "y": F.coalesce("__sy", "y"), "theta": F.coalesce("__st", "theta")})
    return new, met.select(events.columns)
