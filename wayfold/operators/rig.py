"""Flattening of rigs: frame graphs, of which each rigid edge is one row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geometry import compose, inverse


def _reached(edges: DataFrame, base: str, start: str, step: str) -> DataFrame:
    """(id, depth, x): what edges (parent, child, x) lead to, level by level until none is new.

    A recursive query, so depth costs neither plans nor round trips. ``trail`` has the frames on the way, which are not
    entered again; a graph deeper than the session's ``spark.sql.cteRecursionLevelLimit`` is an error, never cut.
    """
    spark, name = edges.sparkSession, f"edges_{uuid.uuid4().hex}"
    edges.createOrReplaceTempView(name)
    try:
        return spark.sql(f"""
            WITH RECURSIVE reached(id, depth, x, trail) AS (
                SELECT {base}, 0, {start}, array({base})
                UNION ALL
                SELECT e.child, r.depth + 1, {step}, array_append(r.trail, e.child) FROM reached r JOIN {name} e ON e.parent = r.id AND NOT array_contains(r.trail, e.child)
            ) SELECT id, depth, x, trail FROM reached""")
    finally:
        spark.catalog.dropTempView(name)


def flattened(edges: DataFrame, base: int = 0) -> DataFrame:
    """(id, depth, x): frames that edges (parent, child, x) lead to from the base, with the summed offset."""
    kind = edges.schema["child"].dataType.simpleString()
    e = edges.select(F.col("parent").cast(kind).alias("parent"), "child", F.col("x").cast("double").alias("x"))
    return _reached(e, f"CAST({base} AS {kind})", "CAST(0 AS DOUBLE)", "r.x + e.x").drop("trail")


def poses(edges: DataFrame, base: str) -> DataFrame:
    """(frame, depth, pose) of every frame that rigid edges connect to the base, in either direction.

    ``edges`` has (parent, child, pose), the pose of the child in the parent's frame, and perhaps ``fixed``: joints that
    are not fixed don't count. An edge that is followed backwards counts inverted. Of several ways to a frame, the one with
    fewest edges holds, of those the first by the names on it. Names lose a leading ``/``. Raises if the base is no frame of the rig.
    """
    e = edges.where("coalesce(fixed, true)") if "fixed" in edges.columns else edges
    bare = lambda c: F.regexp_replace(c, "^/", "")
    e = e.select(bare("parent").alias("parent"), bare("child").alias("child"), "pose")
    base = base.removeprefix("/")
    both = e.unionByName(e.select(F.col("child").alias("parent"), F.col("parent").alias("child"), inverse(F.col("pose")).alias("pose")))
    if both.where(F.col("parent") == base).isEmpty():
        raise ValueError(f"no frame {base} in the rig")
    # way by way: each trail's edges are then composed in order
    links = both.select("parent", "child", F.array(F.struct("parent", "child")).alias("x"))
    kind = links.schema["x"].dataType.simpleString()
    name = base.replace("'", "\\'")
    found = _reached(links, f"'{name}'", f"CAST(array() AS {kind})", "concat(r.x, e.x)")
    best = found.groupBy("id").agg(F.min_by(F.struct("depth", "trail"), F.struct("depth", "trail")).alias("b")).select("id", "b.*")
    table = both.groupBy(F.struct("parent", "child").alias("k")).agg(F.first("pose").alias("pose")).agg(F.map_from_entries(F.collect_list(F.struct("k", "pose"))).alias("table"))
    unit = F.struct(*[F.lit(float(k == "qw")).alias(k) for k in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")])
    steps = F.zip_with(F.slice("trail", F.lit(1), F.col("depth")), F.slice("trail", F.lit(2), F.col("depth")), lambda a, b: F.struct(a.alias("parent"), b.alias("child")))
    pose = F.aggregate(steps, unit, lambda acc, k: compose(acc, F.element_at("table", k)))
    # a rig is tens of frames: its edges are one value, joined to each frame's way
    return best.crossJoin(F.broadcast(table)).select(F.col("id").alias("frame"), "depth", pose.alias("pose"))
