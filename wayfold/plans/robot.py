"""Further queries over the driver's tables: association, gates, lifts, masks, rigs, fields and reports."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions import colour
from wayfold.functions import geometry as geo
from wayfold.operators import fields, folds, graphs, registration, rig, spatial, stats, submaps, temporal, voxel
from wayfold.operators.lineage import cut
from wayfold.plans.queries import _BEFORE, _UPTO, _VOXELS, _W, _voxels, query, r5z, r6
from wayfold.plans.tables import LOG, PLANAR, log, planar, read


@query(f"WITH {LOG} SELECT event_id, run_id, stamp_ns, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, 0.0::DOUBLE AS tz, 1.0::DOUBLE AS qw FROM e")
def stationary(spark, d):
    """The pose that never moves needs no fold: a projection."""
    zero = folds.Stationary().pose
    return log(spark, d).select("event_id", "run_id", "stamp_ns", *[F.lit(v).alias(k) for k, v in zip(("tx", "ty", "tz"), zero, strict=False)], F.lit(zero[-1]).alias("qw"))


def _wrapped(x: str) -> str:
    return f"CASE WHEN {x} > pi() THEN {x} - 2 * pi() WHEN {x} <= -pi() THEN {x} + 2 * pi() ELSE {x} END"


@query(f"""WITH {PLANAR}, l AS (SELECT *, k / 20.0::DOUBLE AS th, lag(x, 1) OVER {_W} AS x1, lag(x, 2) OVER {_W} AS x2, lag(y, 1) OVER {_W} AS y1, lag(y, 2) OVER {_W} AS y2, lag(k, 1) OVER {_W} / 20.0::DOUBLE AS t1, lag(k, 2) OVER {_W} / 20.0::DOUBLE AS t2,
(stamp_ns - lag(stamp_ns, 1) OVER {_W}) * 1e-9::DOUBLE AS dt, (lag(stamp_ns, 1) OVER {_W} - lag(stamp_ns, 2) OVER {_W}) * 1e-9::DOUBLE AS b FROM p),
s AS (SELECT *, CASE WHEN b > 1e-6 AND dt > 0 THEN least(greatest(dt / b, 0), 4) ELSE 0 END AS f FROM l), m AS (SELECT *, f * (cos(t2) * (x1 - x2) + sin(t2) * (y1 - y2)) AS mx, f * (cos(t2) * (y1 - y2) - sin(t2) * (x1 - x2)) AS my, f * ({_wrapped('(t1 - t2)')}) AS mt FROM s),
q AS (SELECT event_id, x1 + cos(t1) * coalesce(mx, 0) - sin(t1) * coalesce(my, 0) AS qx, y1 + sin(t1) * coalesce(mx, 0) + cos(t1) * coalesce(my, 0) AS qy, t1 + coalesce(mt, 0) AS a FROM m)
SELECT event_id, round(qx, 5) + 0.0 AS qx, round(qy, 5) + 0.0 AS qy, round(sin(a), 5) + 0.0 AS sine, round(cos(a), 5) + 0.0 AS cosine FROM q""")
def motion_prediction(spark, d):
    p = planar(spark, d).withColumn("th", F.col("k") / 20.0)
    q = temporal.predicted(p, ["run_id"], "stamp_ns", ["stamp_ns", "event_id"], "x", "y", "th")
    return q.select("event_id", r5z("qx", "qx"), r5z("qy", "qy"), r5z(F.sin("qtheta"), "sine"), r5z(F.cos("qtheta"), "cosine"))


@query(f"""WITH RECURSIVE {PLANAR}, o AS (SELECT run_id, stamp_ns, event_id, k % 3 <> 0 AS fused, coalesce(sqrt((x - lag(x) OVER {_W}) ** 2 + (y - lag(y) OVER {_W}) ** 2), 0) AS moved, row_number() OVER {_W} AS n FROM p),
s(run_id, n, seq, submap, also, part, way, left_) AS (
SELECT run_id, n, event_id, 0, CAST(NULL AS INTEGER), 0, moved, 0 FROM o WHERE n = 1
UNION ALL SELECT run_id, n, seq, submap, CASE WHEN rest > 0 THEN submap - 1 END, CASE WHEN fused AND rest = 0 AND way > 20 THEN 1 ELSE 0 END, way, CASE WHEN fused AND rest > 0 THEN rest - 1 WHEN fused AND way > 20 THEN 3 ELSE rest END FROM
(SELECT o.run_id, o.n, o.event_id AS seq, s.submap + s.part AS submap, CASE WHEN s.part = 1 THEN 0 ELSE s.way END + o.moved AS way, s.left_ AS rest, o.fused FROM s JOIN o ON o.run_id = s.run_id AND o.n = s.n + 1))
SELECT run_id, seq, CAST(submap AS INTEGER) AS submap, also, round(way, 5) AS travelled FROM s""")
def submap_handover(spark, d):
    w = Window.partitionBy("run_id").orderBy("stamp_ns", "event_id")
    moved = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    p = planar(spark, d).select("run_id", "stamp_ns", F.col("event_id").alias("seq"), moved.alias("moved"), (F.col("k") % 3 != 0).alias("fused"))
    return folds.folded(p, lambda: folds.HandOver(20.0, 3), "run_id", ["stamp_ns", "seq"]).select("run_id", "seq", "submap", "also", F.round("travelled", 5).alias("travelled"))


_TURNED = "CASE WHEN abs({0} - {1}) > pi() THEN 2 * pi() - abs({0} - {1}) ELSE abs({0} - {1}) END"
#: The fold of ``submaps.Fusion``: last fused poses by kind (a for scans, c for clouds), the submap and what is left of an overlap.
_FUSED = f"""{PLANAR}, o AS (SELECT run_id, event_id, stamp_ns, x, y, k / 20.0::DOUBLE AS th, CASE WHEN k % 3 = 0 THEN 'cloud' ELSE 'scan' END AS kind, coalesce(sqrt((x - lag(x) OVER {_W}) ** 2 + (y - lag(y) OVER {_W}) ** 2), 0) AS moved, z, row_number() OVER {_W} AS n FROM p),
f(run_id, n, seq, kind, x, y, th, z, fused, submap, also, spawned, left_, way, ax, ay, at_, cx, cy, ct) AS (
SELECT run_id, n, event_id, kind, x, y, th, z, true, 0, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), 0, moved, CASE kind WHEN 'scan' THEN x END, CASE kind WHEN 'scan' THEN y END, CASE kind WHEN 'scan' THEN th END, CASE kind WHEN 'cloud' THEN x END, CASE kind WHEN 'cloud' THEN y END, CASE kind WHEN 'cloud' THEN th END FROM o WHERE n = 1
UNION ALL SELECT run_id, n, seq, kind, x, y, th, z, due, submap, CASE WHEN before > 0 THEN submap - 1 END, CASE WHEN spawns THEN submap + 1 END, CASE WHEN spawns THEN 3 ELSE rest END, way,
CASE WHEN due AND kind = 'scan' THEN x ELSE ax END, CASE WHEN due AND kind = 'scan' THEN y ELSE ay END, CASE WHEN due AND kind = 'scan' THEN th ELSE at_ END, CASE WHEN due AND kind = 'cloud' THEN x ELSE cx END, CASE WHEN due AND kind = 'cloud' THEN y ELSE cy END, CASE WHEN due AND kind = 'cloud' THEN th ELSE ct END
FROM (SELECT *, due AND rest = 0 AND way > 20 AS spawns FROM (SELECT *, CASE WHEN due THEN greatest(before - 1, 0) ELSE before END AS rest FROM (
SELECT o.run_id, o.n, o.event_id AS seq, o.kind, o.x, o.y, o.th, o.z, coalesce(f.spawned, f.submap) AS submap, f.left_ AS before, CASE WHEN f.spawned IS NULL THEN f.way ELSE 0 END + o.moved AS way, f.ax, f.ay, f.at_, f.cx, f.cy, f.ct,
CASE o.kind WHEN 'scan' THEN f.ax IS NULL OR sqrt((o.x - f.ax) ** 2 + (o.y - f.ay) ** 2) > 4 OR {_TURNED.format('o.th', 'f.at_')} > 2 ELSE f.cx IS NULL OR sqrt((o.x - f.cx) ** 2 + (o.y - f.cy) ** 2) > 4 OR {_TURNED.format('o.th', 'f.ct')} > 2 END AS due
FROM f JOIN o ON o.run_id = f.run_id AND o.n = f.n + 1))))"""
_MAPPING = submaps.Mapping(move=4.0, turn=2.0, extent=20.0, overlap=3)
#: Submaps' anchors, the poses written to each, and rays of two points a pose in the anchors' frames.
_LOCAL = f"""{_FUSED}, a AS (SELECT run_id, 0 AS submap, x AS ox, y AS oy, th AS ot FROM f WHERE n = 1 UNION ALL SELECT run_id, spawned, x, y, th FROM f WHERE spawned IS NOT NULL),
w AS (SELECT *, submap AS target FROM f WHERE fused UNION ALL SELECT *, also FROM f WHERE fused AND also IS NOT NULL),
l AS (SELECT w.run_id, target AS submap, seq, kind, z, cos(ot) * (x - ox) + sin(ot) * (y - oy) AS lx, cos(ot) * (y - oy) - sin(ot) * (x - ox) AS ly, {_wrapped('(th - ot)')} AS lt FROM w JOIN a ON a.run_id = w.run_id AND a.submap = w.target),
r AS (SELECT run_id, submap, seq, kind, pid, lx + cos(lt) * 0.1 - sin(lt) * 0.02 AS ox, ly + sin(lt) * 0.1 + cos(lt) * 0.02 AS oy, 0.3::DOUBLE AS oz, lx + cos(lt) * (1.03 + pid) - sin(lt) * (z - 0.5 * pid + 0.017) AS px, ly + sin(lt) * (1.03 + pid) + cos(lt) * (z - 0.5 * pid + 0.017) AS py, z / 2 + 0.011 AS pz FROM l, range(2) j(pid))"""


def _fused_sql(rays: str, name: str) -> str:
    """SQL that observes the rays of a table in the band around their ends, as (run_id, submap, ix, iy, iz, obs)."""
    return f"""{name}q AS (SELECT *, sqrt((px - ox) ** 2 + (py - oy) ** 2 + (pz - oz) ** 2) AS dist FROM {rays}), {name}s AS (SELECT *, greatest(dist - 1.0::DOUBLE, 0.0) AS s0, dist + 1.0::DOUBLE AS s1 FROM {name}q WHERE dist >= 1e-9),
{name}u AS (SELECT *, unnest(range(0, CAST(floor((s1 - s0) / 0.25) AS BIGINT) + 2)) AS step FROM {name}s), {name}v AS (SELECT *, least(s0 + step * 0.25, s1) AS t FROM {name}u),
{name}i AS (SELECT run_id, submap, seq, pid, step, CAST(floor((ox + t * (px - ox) / dist) / 0.5) AS BIGINT) AS ix, CAST(floor((oy + t * (py - oy) / dist) / 0.5) AS BIGINT) AS iy, CAST(floor((oz + t * (pz - oz) / dist) / 0.5) AS BIGINT) AS iz, greatest(-1.0, least(1.0, dist - t)) AS obs FROM {name}v),
{name}l AS (SELECT *, lag(ix) OVER g AS jx, lag(iy) OVER g AS jy, lag(iz) OVER g AS jz FROM {name}i WINDOW g AS (PARTITION BY run_id, submap, seq, pid ORDER BY step)),
{name} AS (SELECT run_id, submap, ix, iy, iz, avg(obs) AS tsdf, count(*) AS weight FROM {name}l WHERE jx IS NULL OR jx <> ix OR jy <> iy OR jz <> iz GROUP BY ALL)"""


def _fusions(spark, d):
    """Every event as a pose of its run: which are fused, and into which submaps."""
    kind = F.when(F.col("k") % 3 == 0, "cloud").otherwise("scan")
    p = planar(spark, d).select("run_id", "stamp_ns", F.col("event_id").alias("seq"), kind.alias("kind"), "x", "y", (F.col("k") / 20.0).alias("theta"))
    return submaps.fusions(p, "run_id", _MAPPING)


def _seen_points(spark, d):
    """Two points that each pose sees."""
    pid = F.explode(F.array(F.lit(0), F.lit(1))).alias("pid")
    p = planar(spark, d).select("run_id", F.col("event_id").alias("seq"), "z", pid)
    at = {"ox": F.lit(0.1), "oy": F.lit(0.02), "oz": F.lit(0.3), "px": F.lit(1.03) + F.col("pid"), "py": F.col("z") - 0.5 * F.col("pid") + 0.017, "pz": F.col("z") / 2 + 0.011}
    return p.withColumns(at).drop("z")


_COARSE = fields.Field(0.5, 1.0, 1e5, 1.0, 0.0)


def _dual(spark, d):
    """(events, anchors, map in space, map in the plane); the events are written once, as all the others read them."""
    events = cut(_fusions(spark, d))
    return events, *submaps.dual(_seen_points(spark, d), events, "run_id", _COARSE, _COARSE, 0.3, F.lit(True), [0.261])


@query(f"""WITH RECURSIVE {_FUSED} SELECT run_id, seq, kind, fused, CAST(submap AS INTEGER) AS submap, CAST(also AS INTEGER) AS also, CAST(spawned AS INTEGER) AS spawned, round(way, 5) AS travelled FROM f""")
def motion_gate(spark, d):
    """Scans and clouds are fused each by their own way since the last fusion; fusions hand submaps over."""
    return _fusions(spark, d).select("run_id", "seq", "kind", "fused", "submap", "also", "spawned", F.round("travelled", 5).alias("travelled"))


@query(f"""WITH RECURSIVE {_LOCAL}, {_fused_sql('r', 'm')} SELECT run_id, CAST(submap AS INTEGER) AS submap, ix, iy, iz, round(tsdf, 5) + 0.0 AS tsdf, CAST(weight AS DOUBLE) AS weight FROM m""")
def dual_integration(spark, d):
    """Maps in space: each fused pose is written to its submap and, in the overlap, to the one before, in the anchors' frames."""
    _, _, space, _ = _dual(spark, d)
    return space.select("run_id", "submap", "ix", "iy", "iz", r5z("tsdf", "tsdf"), "weight")


@query(f"""WITH RECURSIVE {_LOCAL}, h AS (SELECT run_id, submap, seq, pid, ox, oy, 0.0::DOUBLE AS oz, px, py, 0.0::DOUBLE AS pz FROM r WHERE CASE kind WHEN 'scan' THEN pz >= 0.3 ELSE abs(pz - 0.261::DOUBLE) <= 0.05 END), {_fused_sql('h', 'm')}
SELECT run_id, CAST(submap AS INTEGER) AS submap, ix, iy, iz, round(tsdf, 5) + 0.0 AS tsdf, CAST(weight AS DOUBLE) AS weight FROM m""")
def slice_integration(spark, d):
    """Maps in the plane: scans without hits of the floor, and of clouds what lies in the laser's band."""
    *_, plane = _dual(spark, d)
    return plane.select("run_id", "submap", "ix", "iy", "iz", r5z("tsdf", "tsdf"), "weight")


@query(f"""WITH RECURSIVE {_LOCAL}, {_fused_sql('r', 'm')}, z AS (SELECT run_id, max_by(coalesce(spawned, submap), n) AS active, max_by(left_, n) AS left_ FROM f GROUP BY run_id),
b AS (SELECT run_id, submap, 2 + cos(0.5::DOUBLE) * (ox + 0.1 * submap) - sin(0.5::DOUBLE) * oy AS bx, 1 + sin(0.5::DOUBLE) * (ox + 0.1 * submap) + cos(0.5::DOUBLE) * oy AS by_, 0.5 + ot AS bt FROM a)
SELECT m.run_id, CAST(m.submap AS INTEGER) AS submap, CASE WHEN m.submap = active THEN 'active' WHEN m.submap = active - 1 AND left_ > 0 THEN 'overlap' ELSE 'frozen' END AS state, ix, iy, iz,
round(bx + cos(bt) * (ix + 0.5) * 0.5 - sin(bt) * (iy + 0.5) * 0.5, 5) + 0.0 AS wx, round(by_ + sin(bt) * (ix + 0.5) * 0.5 + cos(bt) * (iy + 0.5) * 0.5, 5) + 0.0 AS wy, CAST((iz + 0.5) * 0.5 AS DOUBLE) AS wz FROM m JOIN b ON b.run_id = m.run_id AND b.submap = m.submap JOIN z ON z.run_id = m.run_id""")
def submaps_in_world(spark, d):
    """All submaps in the world, after their anchors were moved: voxels stay as they are, only anchors change."""
    events, at, space, _ = _dual(spark, d)
    moved = at.select("run_id", F.col("submap").alias("node"), (F.col("x") + 0.1 * F.col("submap")).alias("x"), "y", "theta")
    met = submaps.placed(space, submaps.reposed(at, moved, "run_id"), "run_id", 0.5, (2.0, 1.0, 0.5)).join(submaps.states(events, "run_id"), ["run_id", "submap"])
    return met.select("run_id", "submap", "state", "ix", "iy", "iz", r5z("wx", "wx"), r5z("wy", "wy"), "wz")


_COLOURS = LOG + """, d AS (SELECT * FROM e WHERE topic = 'click'), v AS (SELECT run_id, event_id AS colour, stamp_ns AS seen FROM e WHERE topic = 'view'),
c AS (SELECT d.event_id, CASE WHEN abs(d.stamp_ns - v.seen) < 86400000000000 THEN v.colour END AS colour FROM d ASOF LEFT JOIN v ON d.run_id = v.run_id AND d.event_id >= v.colour)"""


def _colours(spark, d):
    """Each depth frame with the colour image delivered last before it, if their stamps are near: delivery is by position, not by time."""
    e = log(spark, d)
    other = e.where("topic = 'view'").select("run_id", F.col("event_id").alias("colour"), F.col("event_id").alias("place"), F.col("stamp_ns").alias("at"))
    frames = e.where("topic = 'click'").withColumn("place", F.col("event_id"))
    met = temporal.latest_before(frames, other, ["run_id"], "place", "event_id", "colour", ["colour", "at"])
    return met.select("event_id", F.when(F.abs(F.col("stamp_ns") - F.col("at")) < 86_400_000_000_000, F.col("colour")).alias("colour"))


@query(f"WITH {_COLOURS} SELECT event_id, colour FROM c")
def colour_of_depth(spark, d):
    return _colours(spark, d)


@query(f"WITH {_COLOURS} SELECT colour, count(*) AS frames FROM c WHERE colour IS NOT NULL GROUP BY colour")
def mask_of_colour(spark, d):
    """Masks are made once for each colour image that a depth frame uses."""
    return _colours(spark, d).where("colour is not null").groupBy("colour").agg(F.count("*").alias("frames"))


@query(f"""WITH {LOG}, i AS (SELECT run_id, min(event_id) AS place FROM e WHERE topic = 'view' GROUP BY run_id), f AS (SELECT c.run_id, c.event_id, i.place, row_number() OVER (PARTITION BY c.run_id, c.event_id < i.place ORDER BY c.event_id) AS n FROM e c JOIN i USING (run_id) WHERE topic = 'click')
SELECT event_id, place AS info FROM f WHERE event_id >= place OR n <= 1""")
def info_for_frames(spark, d):
    e = log(spark, d)
    frames, info = e.where("topic = 'click'").select("run_id", "event_id"), e.where("topic = 'view'").select("run_id", "event_id", F.col("event_id").alias("info"))
    return temporal.with_first_info(frames, info, ["run_id"], ["event_id"], ["info"], 1).select("event_id", "info")


@query(f"""WITH {LOG}, v AS (SELECT run_id, stamp_ns AS t, min(event_id) AS other FROM e WHERE topic = 'view' GROUP BY ALL) SELECT e.event_id, v.other FROM e ASOF LEFT JOIN v ON e.run_id = v.run_id AND e.stamp_ns <= v.t WHERE e.topic = 'purchase'""")
def forward_asof(spark, d):
    e = log(spark, d)
    found = temporal.next_at_or_after(e.where("topic = 'purchase'"), e.where("topic = 'view'"), ["run_id"], "stamp_ns", "event_id", "event_id")
    return found.select("event_id", F.col("other_seq").alias("other"))


@query(f"WITH {_VOXELS}, m AS (SELECT map, ix, iy, iz, avg(obs) AS tsdf FROM v GROUP BY ALL), c AS (SELECT run_id % 5 AS map, CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor((y - 5) / 0.5) AS BIGINT) AS iy, CAST(floor(z / 0.5) AS BIGINT) AS iz, avg(k) AS red FROM p WHERE topic = 'view' GROUP BY ALL) SELECT map, ix, iy, iz, round(tsdf, 6) AS tsdf, round(red, 6) AS red FROM m LEFT JOIN c USING (map, ix, iy, iz)")
def voxel_colour(spark, d):
    cell, v = ["map", "ix", "iy", "iz"], _voxels(spark, d)
    seen = v.where("topic = 'view'").groupBy(*cell).agg(F.avg("k").alias("red"))
    return v.groupBy(*cell).agg(F.avg("obs").alias("tsdf")).join(seen, cell, "left").select(*cell, r6("tsdf", "tsdf"), r6("red", "red"))


@query(f"""WITH {PLANAR}, h AS (SELECT DISTINCT CAST(p_partkey % 11 AS DOUBLE) AS hx, CAST(p_partkey % 7 AS DOUBLE) AS hy FROM part), n AS (SELECT event_id, min(sqrt((x - hx) ** 2 + (y - hy) ** 2)) AS away FROM p, h GROUP BY event_id)
SELECT run_id, round(avg(CASE WHEN least(abs(x - 0), abs(x - 9), abs(y - 0), abs(y - 10)) > 1.5 AND away >= 0.5 THEN 1 ELSE 0 END), 6) AS stale FROM p JOIN n USING (event_id) GROUP BY run_id""")
def stale_ghosts(spark, d):
    """Ghosts that no person stands at in the end; there are 77 different places of persons at most."""
    people = read(spark, d, "part").select((F.col("p_partkey") % 11).cast("double").alias("x"), (F.col("p_partkey") % 7).cast("double").alias("y")).distinct()
    return voxel.stale_ghosts(planar(spark, d), "event_id", ["run_id"], (0, 9, 0, 10), 1.5, people, 0.5).select("run_id", r6("stale", "stale"))


@query(f"WITH {LOG} SELECT topic, arg_max(k % 4, event_id) AS kind FROM e GROUP BY topic")
def topic_types(spark, d):
    return log(spark, d).groupBy("topic").agg(F.max_by(F.col("k") % 4, "event_id").alias("kind"))


@query(f"WITH {LOG} SELECT DISTINCT run_id, 'laser_' || k % 3 AS frame FROM e WHERE topic = 'view'")
def frames_used(spark, d):
    return log(spark, d).where("topic = 'view'").select("run_id", F.concat(F.lit("laser_"), (F.col("k") % 3).cast("string")).alias("frame")).distinct()


_GATES = [("mean_low", "m", "m < 260"), ("mean_high", "m", "m > 240"), ("spread", "s", "s < 160"), ("least", "lo", "lo >= 0"), ("most", "hi", "hi <= 500"), ("rows", "n", "n > 100"), ("ratio", "r", "r < 1.5"), ("share", "q", "q > 0.1"), ("median", "md", "md BETWEEN 200 AND 300"), ("runs", "u", "u > 1"), ("kinds", "t", "t >= 5")]


@query(f"""WITH {LOG}, f AS (SELECT avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, count(*)::DOUBLE AS n, avg(value) / nullif(median(value), 0) AS r, count(*) FILTER (WHERE topic = 'view') / count(*)::DOUBLE AS q, median(value) AS md, count(DISTINCT run_id)::DOUBLE AS u, count(DISTINCT topic)::DOUBLE AS t FROM e),
g AS (SELECT unnest([{", ".join(f"struct_pack(c := '{n}', passed := coalesce({c}, false), shown := {x})" for n, x, c in _GATES)}]) AS g FROM f) SELECT g.c AS "check", g.passed, round(g.shown, 6) AS shown FROM g""")
def selftest_gates(spark, d):
    e = log(spark, d)
    f = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"), (F.avg("value") / F.nullif(F.percentile("value", F.lit(0.5)), F.lit(0.0))).alias("r"), (F.count_if(F.col("topic") == "view") / F.count("*")).alias("q"), F.percentile("value", F.lit(0.5)).alias("md"), F.countDistinct("run_id").alias("u"), F.countDistinct("topic").alias("t"))
    return stats.gated(f, [(n, x, F.expr(c)) for n, x, c in _GATES]).withColumn("shown", F.round("shown", 6))


@query("WITH m AS (SELECT l_suppkey AS sequence, l_returnflag AS config, avg(l_discount) AS mean FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY mean, config) AS n FROM m) SELECT sequence, config, round(mean, 6) AS mean FROM r WHERE n = 1")
def best_config(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("sequence"), F.col("l_returnflag").alias("config"), "l_discount", "_metadata.file_path", "_metadata.row_index")
    return stats.best_mean(l, ["sequence"], "config", "l_discount", ["file_path", "row_index"], 6).select("sequence", "config", r6("mean", "mean"))


def _thin(step: str) -> str:
    return f"WITH {LOG}, n AS (SELECT event_id, run_id, row_number() OVER {_W} - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM e) SELECT event_id, run_id FROM n WHERE i % greatest({step}, 1) = 0"


@query(_thin("CAST(ceil(n / 10.0) AS BIGINT)"))
def point_cap(spark, d):
    return spatial.thinned(log(spark, d), ["run_id"], ["stamp_ns", "event_id"], 10, up=True).select("event_id", "run_id")


@query(_thin("n // 10"))
def registration_subsample(spark, d):
    return spatial.thinned(log(spark, d), ["run_id"], ["stamp_ns", "event_id"], 10).select("event_id", "run_id")


def _lab_sql() -> str:
    light = lambda c: f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE (({c} + 0.055) / 1.055) ** 2.4 END"
    xyz = [f"({' + '.join(f'{k} * l{c}' for k, c in zip(row, 'rgb', strict=True))}) / {w}" for row, w in zip(colour.XYZ, colour.WHITE, strict=True)]
    f = lambda t: f"CASE WHEN {t} > 216 / 24389.0::DOUBLE THEN cbrt({t}) ELSE (24389 / 27.0::DOUBLE * {t} + 16) / 116 END"
    return f"""WITH c AS (SELECT vec_id, abs(embedding[1])::DOUBLE AS r, abs(embedding[2])::DOUBLE AS g, abs(embedding[3])::DOUBLE AS b FROM embeddings), l AS (SELECT vec_id, {", ".join(f"{light(x)} AS l{x}" for x in "rgb")} FROM c),
x AS (SELECT vec_id, {", ".join(f"{e} AS t{i}" for i, e in enumerate(xyz))} FROM l), f AS (SELECT vec_id, {", ".join(f"{f(f't{i}')} AS f{i}" for i in range(3))} FROM x)
SELECT vec_id, round(116 * f1 - 16, 4) AS lightness, round(500 * (f0 - f1), 4) + 0.0 AS a, round(200 * (f1 - f2), 4) + 0.0 AS b FROM f"""


@query(_lab_sql())
def lab_colour(spark, d):
    rgb = [F.abs(F.col("embedding")[k].cast("double")) for k in range(3)]
    lightness, a, b = colour.lab(*rgb)
    return read(spark, d, "embeddings").select("vec_id", F.round(lightness, 4).alias("lightness"), (F.round(a, 4) + 0.0).alias("a"), (F.round(b, 4) + 0.0).alias("b"))


@query("""WITH b AS (SELECT vec_id AS scan, unnest(range(16)) AS beam FROM embeddings), r AS (SELECT scan, beam, (scan % 10) * 0.1::DOUBLE AS ox, (scan % 7) * 0.1::DOUBLE AS oy, cos(beam * 0.4 + 0.05::DOUBLE) AS dx, sin(beam * 0.4 + 0.05::DOUBLE) AS dy FROM b)
SELECT scan, CAST(beam AS INTEGER) AS beam, round(least(CASE WHEN dx > 0 THEN (5 - ox) / dx ELSE (-2 - ox) / dx END, CASE WHEN dy > 0 THEN (4 - oy) / dy ELSE (-2 - oy) / dy END), 6) AS d FROM r""")
def box_rays(spark, d):
    rays = read(spark, d, "embeddings").select(F.col("vec_id").alias("scan"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("beam"))
    angle = F.col("beam") * 0.4 + F.lit(0.05)
    hit = spatial.ray_box(F.col("scan") % 10 * 0.1, F.col("scan") % 7 * 0.1, F.cos(angle), F.sin(angle), -2.0, 5.0, -2.0, 4.0)
    return rays.select("scan", "beam", r6(hit, "d"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE * 3, 6) + 0.0 AS yaw, (CAST(120 AS BIGINT) << 56) | vec_id AS key FROM embeddings")
def quaternion_yaw(spark, d):
    """The yaw of a turn about the vertical, and the key of the pose in a graph: its letter in the top byte, the index below."""
    yaw = F.col("embedding")[0].cast("double") * 3
    e = read(spark, d, "embeddings").select("vec_id", geo.from_rpy(F.lit(0.0), F.lit(0.0), yaw).alias("q"))
    return e.select("vec_id", r5z_six(geo.yaw(F.col("q"))).alias("yaw"), geo.symbol_key("x", F.col("vec_id")).alias("key"))


def r5z_six(c):
    return F.round(c, 6) + F.lit(0.0)


@query(f"""WITH {PLANAR}, b AS (SELECT event_id, run_id, 0.2 + cos(0.1::DOUBLE) * x - sin(0.1::DOUBLE) * y AS bx, sin(0.1::DOUBLE) * x + cos(0.1::DOUBLE) * y AS by_, 0.5 + z AS bz FROM p),
t AS (SELECT event_id, run_id % 3 <> 0 AS tilted, bx AS px, CASE WHEN run_id % 3 <> 0 THEN cos(0.05::DOUBLE) * by_ - sin(0.05::DOUBLE) * bz ELSE by_ END AS py, CASE WHEN run_id % 3 <> 0 THEN sin(0.05::DOUBLE) * by_ + cos(0.05::DOUBLE) * bz ELSE bz END AS pz FROM b)
SELECT event_id, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz FROM t WHERE NOT (tilted AND pz < 0.7)""")
def lifted_points(spark, d):
    tilt = F.when(F.col("run_id") % 3 != 0, geo.from_rpy(F.lit(0.05), F.lit(0.0), F.lit(0.0)))
    p = spatial.lifted(planar(spark, d), geo.literal_pose(0.2, 0.0, 0.5, yaw=0.1), tilt, 0.7, F.lit(1.6))
    return p.select("event_id", r6("px", "px"), r6("py", "py"), r6("pz", "pz"))


@query(f"WITH {PLANAR} SELECT event_id, z FROM p WHERE abs(z - 0.5) <= 0.05 OR abs(z - 1.2) <= 0.05")
def band_gate(spark, d):
    return spatial.in_bands(planar(spark, d), "z", [0.5, 1.2], 0.05).select("event_id", "z")


@query(f"""WITH {LOG}, m AS (SELECT DISTINCT run_id, k % 40 AS mu, event_id % 30 AS mv FROM e WHERE topic = 'error'), x AS (SELECT event_id, run_id, (k * 6) % 640 AS u, event_id % 480 AS v FROM e WHERE topic = 'view')
SELECT event_id, CAST(u AS INTEGER) AS u, v FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.run_id = x.run_id AND m.mu = u * 40 // 640 AND m.mv = v * 30 // 480)""")
def masked_pixels(spark, d):
    e = log(spark, d)
    mask = e.where("topic = 'error'").select("run_id", (F.col("k") % 40).cast("long").alias("mu"), (F.col("event_id") % 30).cast("long").alias("mv"))
    pixels = e.where("topic = 'view'").select("event_id", "run_id", (F.col("k") * 6 % 640).cast("int").alias("u"), (F.col("event_id") % 480).alias("v"))
    return spatial.masked(pixels, mask, "u", "v", (640, 480), (40, 30), ["run_id"]).select("event_id", "u", "v")


@query("""WITH i AS (SELECT p_partkey, p_size * 37.0::DOUBLE AS w, 480.0::DOUBLE AS h FROM part), s AS (SELECT *, least(640 / w, 640 / h) AS scale FROM i)
SELECT p_partkey, round(scale, 6) AS scale, round((640 - w * scale) / 2, 6) + 0.0 AS pad_x, round((640 - h * scale) / 2, 6) + 0.0 AS pad_y FROM s""")
def letterbox_fit(spark, d):
    scale, px, py = spatial.letterbox(F.col("p_size") * 37.0, F.lit(480.0), 640)
    return read(spark, d, "part").select("p_partkey", r6(scale, "scale"), r5z_six(px).alias("pad_x"), r5z_six(py).alias("pad_y"))


@query("SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: embedding[i]::DOUBLE * embedding[i + 32]::DOUBLE)) > 0 AS inside FROM embeddings")
def mask_logits(spark, d):
    """A mask's pixel is inside where its coefficients' product with the prototypes is above 0."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    dot = F.aggregate(F.zip_with(F.slice(x, 1, 32), F.slice(x, 33, 32), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return read(spark, d, "embeddings").select("vec_id", (dot > 0).alias("inside"))


@query("SELECT vec_id, round(sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2), 6) AS off, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2) > 0.017 AS warned FROM embeddings")
def planarity_warning(spark, d):
    off = F.hypot(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"))
    return read(spark, d, "embeddings").select("vec_id", r6(off, "off"), (off > 0.017).alias("warned"))


@query("""WITH RECURSIVE n AS (SELECT (n_nationkey - 1) // 2 AS a, n_nationkey AS b, n_regionkey * 0.5::DOUBLE AS x, 0.1::DOUBLE * n_nationkey AS t FROM nation WHERE n_nationkey > 0),
g AS (SELECT a, b, x, 0.0::DOUBLE AS y, t FROM n UNION ALL SELECT b, a, -cos(t) * x, sin(t) * x, -t FROM n),
r(id, depth, x, y, t, trail) AS (SELECT 3, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, [3] UNION ALL SELECT CAST(g.b AS INTEGER), r.depth + 1, r.x + cos(r.t) * g.x - sin(r.t) * g.y, r.y + sin(r.t) * g.x + cos(r.t) * g.y, r.t + g.t, list_append(r.trail, CAST(g.b AS INTEGER)) FROM r JOIN g ON g.a = r.id AND NOT list_contains(r.trail, CAST(g.b AS INTEGER)))
SELECT 'f' || id AS frame, depth, round(x, 5) + 0.0 AS tx, round(y, 5) + 0.0 AS ty, round(sin(t), 5) + 0.0 AS sine FROM r""")
def rig_poses(spark, d):
    """Frames reached from one inside the tree, over edges in both directions."""
    n = F.col("n_nationkey")
    edges = read(spark, d, "nation").where("n_nationkey > 0").select(F.concat(F.lit("/f"), F.expr("(n_nationkey - 1) div 2").cast("string")).alias("parent"), F.concat(F.lit("f"), n.cast("string")).alias("child"), geo.pose(geo.vector(F.col("n_regionkey") * 0.5, 0.0, 0.0), geo.from_rpy(F.lit(0.0), F.lit(0.0), n * 0.1)).alias("pose"))
    found = rig.poses(edges, "f3")
    return found.select("frame", "depth", r5z("pose.tx", "tx"), r5z("pose.ty", "ty"), r5z(2 * F.col("pose.qz") * F.col("pose.qw"), "sine"))


@query("""WITH m AS (SELECT s_nationkey AS n, avg(s_acctbal) AS score, max(CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT)) AS peak FROM supplier WHERE s_acctbal > 0 GROUP BY 1), b AS (SELECT c_nationkey AS n, avg(c_acctbal) AS base FROM customer GROUP BY 1)
SELECT n_name AS sequence, round(score, 4) AS score, peak, round(score / base, 4) AS ratio FROM nation LEFT JOIN m ON m.n = n_nationkey LEFT JOIN b ON b.n = n_nationkey""")
def report_rows(spark, d):
    """Results by sequence with what their logs say and the archived baseline; what is missing stays null."""
    score = read(spark, d, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.avg("s_acctbal").alias("score"), F.max(F.regexp_extract("s_name", "([0-9]+)$", 1).cast("long")).alias("peak"))
    base = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("base"))
    met = read(spark, d, "nation").join(score, "n_nationkey", "left").join(base, "n_nationkey", "left")
    return met.select(F.col("n_name").alias("sequence"), F.round("score", 4).alias("score"), "peak", F.round(F.col("score") / F.col("base"), 4).alias("ratio"))


@query(f"""WITH {LOG}, t AS (SELECT event_id, run_id, stamp_ns, k / 1e6 AS g, value / 1e6 AS f, coalesce((stamp_ns - lag(stamp_ns) OVER {_W}) * 1e-9::DOUBLE, 0) AS dt FROM e),
a AS (SELECT *, coalesce(sum(g * dt) OVER {_BEFORE}, 0) AS b FROM t), v AS (SELECT run_id, stamp_ns, event_id, sum(dt) OVER {_UPTO} AS dt, sum(cos(b) * f * dt) OVER {_UPTO} AS vx, sum(sin(b) * f * dt) OVER {_UPTO} AS vy FROM a)
SELECT run_id, stamp_ns, round(dt, 6) AS dt, round(vx, 5) + 0.0 AS vx, round(vy, 5) + 0.0 AS vy FROM v""")
def preintegration(spark, d):
    e = log(spark, d).select("run_id", "stamp_ns", F.col("event_id").alias("seq"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), (F.col("k") / 1e6).alias("gz"), (F.col("value") / 1e6).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"))
    p = folds.folded(e, fields.Preintegration, "run_id", ["stamp_ns", "seq"])
    return p.select("run_id", "stamp_ns", F.round("dt", 6).alias("dt"), r5z("vx", "vx"), r5z("vy", "vy"))


def _folded_voxels(most: float, carve: float) -> str:
    """SQL that folds the events of a voxel (kind 0: passed, 1: observed) in order; an event is laid out as the state is."""
    state = lambda **k: "struct_pack(" + ", ".join(f"{c} := {k.get(c, f'a.{c}')}" for c in ("kind", "obs", "colour", "tsdf", "weight", "red", "n", "observed", "carved")) + ")"
    passed = f"CASE WHEN a.weight <= 0 THEN a WHEN a.weight * {carve} < 1 THEN {state(tsdf='0.0::DOUBLE', weight='0.0::DOUBLE', red='0.0::DOUBLE', n='0::BIGINT', carved='a.carved + 1')} ELSE {state(weight=f'a.weight * {carve}::DOUBLE', carved='a.carved + 1')} END"
    painted = {"red": "CASE WHEN e.colour IS NULL THEN a.red ELSE a.red + (e.colour - a.red) / (a.n + 1) END", "n": "CASE WHEN e.colour IS NULL THEN a.n ELSE least(a.n + 1, 32) END"}
    seen = state(tsdf="(a.tsdf * a.weight + e.obs) / (a.weight + 1)", weight=f"least(a.weight + 1, {most}::DOUBLE)", observed="a.observed + 1", **painted)
    return f"list_reduce(events, lambda a, e: CASE WHEN e.kind = 0 THEN {passed} ELSE {seen} END)"


@query(f"""WITH {PLANAR}, q AS (SELECT run_id % 5 AS map, stamp_ns, event_id, k::DOUBLE AS paint, x AS px, y AS py, z AS pz, sqrt(x * x + y * y + z * z) AS dist FROM p), s AS (SELECT *, greatest(dist - 0.5::DOUBLE, 0.0) AS a, dist + 0.5::DOUBLE AS b FROM q WHERE dist >= 1e-9),
w AS (SELECT *, unnest(range(0, CAST(floor((b - a) / 0.125) AS BIGINT) + 2)) AS step FROM s), v AS (SELECT *, least(a + step * 0.125, b) AS t FROM w),
i AS (SELECT *, CAST(floor(t * px / dist / 0.25) AS BIGINT) AS ix, CAST(floor(t * py / dist / 0.25) AS BIGINT) AS iy, CAST(floor(t * pz / dist / 0.25) AS BIGINT) AS iz, greatest(-0.5, least(0.5, dist - t)) AS obs FROM v),
l AS (SELECT *, lag(ix) OVER g AS jx, lag(iy) OVER g AS jy, lag(iz) OVER g AS jz FROM i WINDOW g AS (PARTITION BY event_id ORDER BY step)),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id, ix, iy, iz ORDER BY step) AS n FROM l WHERE jx IS NULL OR jx <> ix OR jy <> iy OR jz <> iz),
f AS (SELECT *, greatest(dist - 0.5::DOUBLE, 0.0) - 0.25 AS free FROM q WHERE dist >= 1e-9), u AS (SELECT *, unnest(range(0, CAST(floor(free / 0.25) AS BIGINT) + 2)) AS step FROM f WHERE free >= 0.25),
c AS (SELECT *, least(step * 0.25, free) AS t FROM u), ci AS (SELECT *, CAST(floor(t * px / dist / 0.25) AS BIGINT) AS ix, CAST(floor(t * py / dist / 0.25) AS BIGINT) AS iy, CAST(floor(t * pz / dist / 0.25) AS BIGINT) AS iz FROM c WHERE dist - t > greatest(0.1::DOUBLE * t, 1.0)),
cl AS (SELECT *, lag(ix) OVER g AS jx, lag(iy) OVER g AS jy, lag(iz) OVER g AS jz FROM ci WINDOW g AS (PARTITION BY event_id ORDER BY step)),
cc AS (SELECT * FROM cl SEMI JOIN o USING (map, ix, iy, iz) WHERE jx IS NULL OR jx <> ix OR jy <> iy OR jz <> iz),
e0 AS (SELECT map, ix, iy, iz, stamp_ns, event_id, 1 AS kind, step, obs, CASE WHEN n = 1 AND ix = CAST(floor(px / 0.25) AS BIGINT) AND iy = CAST(floor(py / 0.25) AS BIGINT) AND iz = CAST(floor(pz / 0.25) AS BIGINT) THEN paint END AS colour FROM o
UNION ALL SELECT map, ix, iy, iz, stamp_ns, event_id, 0, step, NULL, NULL FROM cc
UNION ALL SELECT DISTINCT map, ix, iy, iz, -1, -1, -1, 0, NULL, NULL FROM o),
g AS (SELECT map, ix, iy, iz, list(struct_pack(kind := kind, obs := obs, colour := colour, tsdf := 0.0::DOUBLE, weight := 0.0::DOUBLE, red := 0.0::DOUBLE, n := 0::BIGINT, observed := 0::BIGINT, carved := 0::BIGINT) ORDER BY stamp_ns, event_id, kind, step) AS events FROM e0 GROUP BY ALL),
r AS (SELECT map, ix, iy, iz, {_folded_voxels(1e5, 0.5)} AS s FROM g)
SELECT map, ix, iy, iz, round(s.tsdf + 1e-9, 5) + 0.0 AS tsdf, round(s.weight + 1e-9, 5) AS weight, CASE WHEN s.n > 0 THEN round(s.red + 1e-9, 5) END AS red, CAST(s.n AS INTEGER) AS n_red, s.observed AS observed, s.carved AS carved FROM r""")
def carved_map(spark, d):
    """Rays of a map in order of time, fused with carving and colour; the SQL folds each voxel's list of events.

    Means of few observations often lie between two rounded values, so a billionth is added before rounding.
    """
    p = planar(spark, d)
    rays = p.select((F.col("run_id") % 5).alias("map"), "stamp_ns", "event_id", *[F.lit(0.0).alias(f"o{a}") for a in voxel.AXES], *[F.col(a).alias(f"p{a}") for a in voxel.AXES], F.col("k").cast("double").alias("red"))
    found = fields.fused(rays, ["map"], ["stamp_ns", "event_id"], fields.Field(0.25, 0.5, 1e5, 0.5, 0.1), "red")
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 5) + F.lit(0.0) for c in ("tsdf", "weight", "red")})


@query(f"""WITH RECURSIVE {PLANAR}, o AS (SELECT run_id, x, y, coalesce(sqrt((x - lag(x) OVER {_W}) ** 2 + (y - lag(y) OVER {_W}) ** 2), 0) AS d, row_number() OVER {_W} AS n FROM p),
s(run_id, n, sx, sy, way, far) AS (SELECT run_id, n, x, y, 0.0::DOUBLE, CAST(NULL AS DOUBLE) FROM o WHERE n = 1 UNION ALL
SELECT o.run_id, o.n, CASE WHEN s.way + o.d >= 10 THEN o.x ELSE s.sx END, CASE WHEN s.way + o.d >= 10 THEN o.y ELSE s.sy END, CASE WHEN s.way + o.d >= 10 THEN 0 ELSE s.way + o.d END, CASE WHEN s.way + o.d >= 10 THEN sqrt((o.x - s.sx) ** 2 + (o.y - s.sy) ** 2) END FROM s JOIN o ON o.run_id = s.run_id AND o.n = s.n + 1)
SELECT run_id, count(far) AS pairs, round(avg(far), 5) AS mean_step FROM s WHERE far IS NOT NULL GROUP BY run_id""")
def rpe_segments(spark, d):
    """Pairs along the path, each begun where the one before reached the length."""
    q = stats.arc_pairs(planar(spark, d), "run_id", ["stamp_ns", "event_id"], ["x", "y"], 10.0)
    step = F.hypot(F.col("to_x") - F.col("from_x"), F.col("to_y") - F.col("from_y"))
    return q.groupBy("run_id").agg(F.count("*").alias("pairs"), F.round(F.avg(step), 5).alias("mean_step"))


_ROOM = (-6.0, 6.0, -4.0, 4.0)


def _seen_from(df, beams: int):
    """``df`` with (x, y, theta) and the ranges of a fan of beams to the walls of a room, and to a round pillar in it."""
    step = 2 * math.pi / beams
    angle = lambda b: F.col("theta") - math.pi + b * step
    wall = lambda b: spatial.ray_box(F.col("x"), F.col("y"), F.cos(angle(b)), F.sin(angle(b)), *_ROOM)
    pillar = lambda b: spatial.ray_circle(F.col("x"), F.col("y"), F.cos(angle(b)), F.sin(angle(b)), F.lit(2.0), F.lit(1.5), F.lit(0.6))
    ranges = F.transform(F.sequence(F.lit(0), F.lit(beams - 1)), lambda b: F.least(wall(b), pillar(b)))
    return df.withColumns({"ranges": ranges, "angle_min": F.lit(-math.pi), "angle_increment": F.lit(step), "range_min": F.lit(0.05), "range_max": F.lit(25.0)})


def _walk(spark, d):
    """Each label's vectors, in order, as poses along a gentle curve: known truth for what is estimated from scans taken there."""
    w = Window.partitionBy("run_id").orderBy("seq")
    e = read(spark, d, "embeddings").select(F.col("label").alias("run_id"), F.col("vec_id").alias("seq")).withColumn("i", F.row_number().over(w) - 1)
    t = F.col("i") * 0.05
    return e.withColumns({"stamp_ns": F.col("i").cast("long") * 100_000_000, "x": 2.5 * F.sin(t) * 0.6, "y": 0.8 * (1 - F.cos(t)), "theta": 0.3 * F.sin(t)})


@query("SELECT label AS run_id, vec_id AS seq, true AS near, 'known' AS outcome FROM embeddings")
def scan_odometry(spark, d):
    """Scans in a room with a pillar; the SQL is the truth: no estimate is 5 cm or 0.02 rad off, and none coasts."""
    walk = _walk(spark, d)
    # poses are small and beams cost: dealt by number, or the poses of all runs would be left to a few tasks
    dealt = walk.repartition(4 * spark.sparkContext.defaultParallelism, "run_id", "seq")
    found = folds.folded(_seen_from(dealt, 240).select("run_id", "seq", "stamp_ns", "ranges", "angle_min", "angle_increment", "range_min", "range_max"), registration.ScanOdometry, "run_id", ["stamp_ns", "seq"])
    met = found.withColumnsRenamed({"x": "ex", "y": "ey", "theta": "et"}).join(walk.drop("i"), ["run_id", "stamp_ns"])
    near = (F.hypot(F.col("ex") - F.col("x"), F.col("ey") - F.col("y")) < 0.05) & (F.abs(geo.wrap_angle(F.col("et") - F.col("theta"))) < 0.02)
    return met.select("run_id", "seq", near.alias("near"), F.when(F.col("outcome").isin("keyframe", "matched"), "known").otherwise(F.col("outcome")).alias("outcome"))


@query("""WITH n AS (SELECT s_nationkey AS run_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS node, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), t AS (SELECT *, node * 2 * pi() / n AS a FROM n WHERE n > 1)
SELECT run_id, CAST(node AS INTEGER) AS node, round(10 * cos(a) - 10, 4) + 0.0 AS x, round(10 * sin(a), 4) + 0.0 AS y, round(sin(a), 4) + 0.0 AS sine, round(cos(a), 4) + 0.0 AS cosine FROM t""")
def pose_graph(spark, d):
    """Anchors of each nation on a circle, measured without error but told with drift: the optimum is the circle, whose poses the SQL computes."""
    w = Window.partitionBy("run_id").orderBy("id")
    n = read(spark, d, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("id")).withColumns({"node": (F.row_number().over(w) - 1).cast("int"), "n": F.count("*").over(Window.partitionBy("run_id"))}).where("n > 1")
    a = F.col("node") * 2 * math.pi / F.col("n")
    truth = n.select("run_id", "node", "n", (10 * F.cos(a) - 10).alias("tx"), (10 * F.sin(a)).alias("ty"), geo.wrap_angle(a + 0.0).alias("tt"))
    drift = truth.select("run_id", "node", (F.col("tx") + F.col("node") * 0.02).alias("x"), (F.col("ty") - F.col("node") * 0.01).alias("y"), (F.col("tt") + F.col("node") * 0.001).alias("theta"))
    to = truth.select("run_id", F.col("node").alias("to"), *[F.col(f"t{c}").alias(f"b{c}") for c in "xyt"])
    pair = lambda df: df.join(to, ["run_id", "to"])
    hops = pair(truth.withColumn("to", F.col("node") + 1)).withColumns({"sigma_turn": F.lit(0.05), "sigma_move": F.lit(0.2)})
    loops = pair(truth.where("node = 0").withColumn("to", (F.col("n") - 1).cast("int"))).withColumns({"sigma_turn": F.lit(0.01), "sigma_move": F.lit(0.05)})
    dx, dy, c, s = F.col("bx") - F.col("tx"), F.col("by") - F.col("ty"), F.cos("tt"), F.sin("tt")
    edges = hops.unionByName(loops).select("run_id", F.col("node").alias("from"), "to", (c * dx + s * dy).alias("dx"), (c * dy - s * dx).alias("dy"), geo.wrap_angle(F.col("bt") - F.col("tt")).alias("dtheta"), "sigma_turn", "sigma_move")
    r4z = lambda e, name: (F.round(e, 4) + F.lit(0.0)).alias(name)
    found = submaps.solved_by_size(drift, edges, "run_id")
    return found.select("run_id", "node", r4z(F.col("x"), "x"), r4z(F.col("y"), "y"), r4z(F.sin("theta"), "sine"), r4z(F.cos("theta"), "cosine"))


@query("""WITH n AS (SELECT c_nationkey AS run_id, c_custkey, 1 + (c_custkey % 7) / 10.0::DOUBLE AS hop, row_number() OVER w - 1 AS node, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
t AS (SELECT *, coalesce(sum(hop) OVER (PARTITION BY run_id ORDER BY node ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after, sum(hop) OVER (PARTITION BY run_id) AS whole FROM n WHERE n > 2)
SELECT run_id, CAST(node AS INTEGER) AS node, round(whole - after - first_value(hop) OVER (PARTITION BY run_id ORDER BY node) + 0.5 * node * 0.04::DOUBLE / ((n - 1) * 0.04::DOUBLE + 0.0025::DOUBLE), 4) + 0.0 AS x, 0.0::DOUBLE AS y FROM t""")
def pose_graph_spread(spark, d):
    """Chains of customers whose loop says half a metre more than their hops do: each hop takes its share of it, by its variance.

    Solved as sparse equations of all graphs together. On a line the optimum has a closed form, which is the SQL.
    """
    w = Window.partitionBy("run_id").orderBy("c_custkey")
    n = read(spark, d, "customer").select(F.col("c_nationkey").alias("run_id"), "c_custkey", (1 + F.col("c_custkey") % 7 / 10.0).alias("hop")).withColumns({"node": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("run_id"))}).where("n > 2")
    told = n.withColumn("x", F.sum(F.when(F.col("node") > 0, F.col("hop")).otherwise(0.0)).over(w))
    anchors = told.select("run_id", "node", "x", F.lit(0.0).alias("y"), F.lit(0.0).alias("theta"))
    zero = [F.lit(0.0).alias("dy"), F.lit(0.0).alias("dtheta")]
    hops = told.where("node > 0").select("run_id", (F.col("node") - 1).alias("from"), F.col("node").alias("to"), F.col("hop").alias("dx"), *zero, F.lit(0.05).alias("sigma_turn"), F.lit(0.2).alias("sigma_move"))
    loops = told.where("node = n - 1").select("run_id", F.lit(0).alias("from"), F.col("node").alias("to"), (F.col("x") + 0.5).alias("dx"), *zero, F.lit(0.01).alias("sigma_turn"), F.lit(0.05).alias("sigma_move"))
    found = graphs.planar(anchors, hops.unionByName(loops), "run_id").variables
    r4z = lambda e, name: (F.round(e, 4) + F.lit(0.0)).alias(name)
    return found.select(F.col("graph").cast("int").alias("run_id"), F.col("v").cast("int").alias("node"), r4z(F.col("value")[0], "x"), r4z(F.col("value")[1], "y"))


@query("""WITH n AS (SELECT s_nationkey AS run_id, s_suppkey AS seq, 1 + (s_suppkey % 7) / 10.0::DOUBLE AS hop, row_number() OVER w - 1 AS node, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
t AS (SELECT *, sum(CASE WHEN node > 0 THEN hop ELSE 0 END) OVER (PARTITION BY run_id ORDER BY node) + CASE WHEN n > 2 THEN 0.5 * node * 0.04::DOUBLE / ((n - 1) * 0.04::DOUBLE + 0.0025::DOUBLE) ELSE 0 END AS anchor, sum(CASE WHEN node > 0 THEN hop ELSE 0 END) OVER (PARTITION BY run_id) AS whole FROM n)
SELECT run_id, seq, CAST(node AS INTEGER) AS submap, round(anchor, 4) + 0.0 AS anchor_x, round(CASE WHEN node = n - 1 AND n > 2 THEN whole + 0.8 ELSE anchor + 0.3 END, 4) + 0.0 AS x FROM t""")
def loop_closing(spark, d):
    """Each supplier a submap on its nation's line with a pose 30 cm ahead; the last pose closes a loop with the first submap, half a metre off.

    Anchors take their shares of it, poses go with them, and the one that closed the loop is where the closure says.
    """
    w = Window.partitionBy("run_id").orderBy("seq")
    n = read(spark, d, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("seq")).withColumns({"hop": 1 + F.col("seq") % 7 / 10.0, "submap": (F.row_number().over(w) - 1).cast("int"), "n": F.count("*").over(Window.partitionBy("run_id"))})
    told = n.withColumn("x", F.sum(F.when(F.col("submap") > 0, F.col("hop")).otherwise(0.0)).over(w)).withColumns({"y": F.lit(0.0), "theta": F.lit(0.0)})
    anchors = told.select("run_id", "submap", "seq", "x", "y", "theta")
    events = told.select("run_id", "seq", "submap", F.lit(None).cast("int").alias("also"), (F.col("x") + 0.3).alias("x"), "y", "theta")
    closures = told.where("submap = n - 1 and n > 2").select("run_id", "seq", F.lit(0).alias("target"), (F.col("x") + 0.8).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("ctheta"))
    new, poses = submaps.closed(closures, events, anchors, "run_id", submaps.solved_by_size)
    r4z = lambda e, name: (F.round(e, 4) + F.lit(0.0)).alias(name)
    return poses.join(new.select("run_id", "submap", F.col("x").alias("ax")), ["run_id", "submap"]).select("run_id", "seq", "submap", r4z(F.col("ax"), "anchor_x"), r4z(F.col("x"), "x"))
