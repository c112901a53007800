"""One query per operator over the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as geo
from wayfold.functions.time import format_stamp, parse_stamp
from wayfold.operators import folds, spatial, stats, temporal, voxel
from wayfold.operators.rig import flattened
from wayfold.plans.tables import LOG, PLANAR, beams, log, planar, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c, name):
    return F.round(c, 6).alias(name)


def r5z(c, name):
    """Rounded, and zero without a sign."""
    return (F.round(c, 5) + F.lit(0.0)).alias(name)


@query(f"""WITH {LOG}, m AS (SELECT *, CASE topic WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS kind_rank FROM e WHERE topic IN ('click', 'view', 'purchase'))
SELECT run_id, event_id, topic, CAST(row_number() OVER (PARTITION BY run_id ORDER BY stamp_ns, kind_rank, event_id) AS INTEGER) AS pos FROM m""")
def merged_events(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    m = temporal.merge_streams([e.where(F.col("topic") == t) for t in ("click", "view", "purchase")])
    return temporal.numbered(m, ["run_id"], ["stamp_ns", "kind_rank", "event_id"]).select("run_id", "event_id", "topic", "pos")


@query(f"WITH {LOG} SELECT topic, count(*) AS n, min(stamp_ns) AS first_ns, max(stamp_ns) AS last_ns FROM e GROUP BY topic")
def topic_catalog(spark, d):
    return log(spark, d).groupBy("topic").agg(F.count("*").alias("n"), F.min("stamp_ns").alias("first_ns"), F.max("stamp_ns").alias("last_ns"))


@query(f"""WITH {LOG}, g AS (SELECT * FROM e WHERE topic = 'click'), a AS (SELECT run_id, stamp_ns AS t, value AS v FROM e WHERE topic = 'view'),
s AS (SELECT run_id, min(t) AS lo, max(t) AS hi FROM a GROUP BY run_id),
b AS (SELECT g.event_id, g.run_id, g.stamp_ns, g.value, x.t AS t0, x.v AS v0, y.t AS t1, y.v AS v1
      FROM g JOIN s ON g.run_id = s.run_id AND g.stamp_ns BETWEEN s.lo AND s.hi
      ASOF LEFT JOIN a x ON g.run_id = x.run_id AND g.stamp_ns > x.t
      ASOF LEFT JOIN a y ON g.run_id = y.run_id AND g.stamp_ns <= y.t)
SELECT event_id, run_id, round(value, 6) AS gyro, round(CASE WHEN t0 IS NULL OR t1 = t0 THEN coalesce(v0, v1) ELSE v0 + (stamp_ns - t0)::DOUBLE / (t1 - t0) * (v1 - v0) END, 6) AS accel FROM b""")
def split_stream_merge(spark, d):
    e = log(spark, d)
    gyro, accel = e.where("topic = 'click'"), e.where("topic = 'view'")
    m = temporal.interpolate_at(gyro, accel, ["run_id"], "stamp_ns", "event_id", "event_id", "value", "accel")
    return m.select("event_id", "run_id", r6("value", "gyro"), r6("accel", "accel"))


@query(f"""WITH {LOG}, b AS (SELECT * FROM e WHERE topic = 'purchase'), o AS (SELECT run_id, stamp_ns, event_id AS colour, value AS level FROM e WHERE topic = 'view')
SELECT b.event_id, CASE WHEN b.stamp_ns - o.stamp_ns < 3600000000000 THEN o.colour END AS colour, CASE WHEN b.stamp_ns - o.stamp_ns < 3600000000000 THEN o.level END AS level
FROM b ASOF LEFT JOIN o ON b.run_id = o.run_id AND b.stamp_ns >= o.stamp_ns""")
def latest_before_gate(spark, d):
    e = log(spark, d)
    other = e.where("topic = 'view'").select("run_id", "stamp_ns", F.col("event_id").alias("colour"), F.col("value").alias("level"))
    found = temporal.latest_before(e.where("topic = 'purchase'"), other, ["run_id"], "stamp_ns", "event_id", "colour", ["colour", "level"], 3_600_000_000_000)
    return found.select("event_id", "colour", "level")


@query(f"""WITH {LOG}, m AS (SELECT b.event_id, o.event_id AS other, abs(o.stamp_ns - b.stamp_ns) AS dt FROM e b JOIN e o ON b.run_id = o.run_id AND b.topic = 'error' AND o.topic = 'view'
AND abs(o.stamp_ns - b.stamp_ns) <= 1800000000000), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dt, other) AS n FROM m)
SELECT event_id, other, dt FROM r WHERE n = 1""")
def nearest_assoc(spark, d):
    e = log(spark, d)
    found = temporal.nearest_within(e.where("topic = 'error'"), e.where("topic = 'view'"), ["run_id"], "stamp_ns", "event_id", "event_id", 1_800_000_000_000)
    return found.select("event_id", F.col("other_seq").alias("other"), "dt")


@query(f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY stamp_ns, event_id) AS n FROM e) SELECT run_id, topic, event_id, value FROM r WHERE n = 1""")
def first_info_wins(spark, d):
    return temporal.first_wins(log(spark, d), ["run_id", "topic"], ["stamp_ns", "event_id"]).select("run_id", "topic", "event_id", "value")


@query("""WITH s AS (SELECT s_suppkey, CAST('/' || s_name AS VARCHAR) AS frame, s_nationkey FROM supplier), r AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20)
SELECT coalesce(r.n_name, '?') AS name, count(*) AS n, CAST(count(*) FILTER (WHERE r.n_name IS NULL) AS BIGINT) AS skipped FROM s LEFT JOIN r ON s.s_nationkey = r.n_nationkey GROUP BY 1""")
def frame_lookup(spark, d):
    rig = read(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    found = read(spark, d, "supplier").join(rig, "s_nationkey", "left")
    return found.groupBy(F.coalesce("n_name", F.lit("?")).alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("n_name").isNull()).alias("skipped"))


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY stamp_ns, event_id) AS n FROM e) SELECT event_id, run_id, topic FROM r WHERE (n - 1) % 3 = 0")
def decimate(spark, d):
    return temporal.every_nth(log(spark, d), 3, ["run_id", "topic"], ["stamp_ns", "event_id"]).select("event_id", "run_id", "topic")


@query("""WITH s AS (SELECT vec_id AS scan, unnest(embedding) AS r0, generate_subscripts(embedding, 1) - 1 AS beam FROM embeddings), b AS (SELECT scan, beam, r0::DOUBLE * 40 AS r FROM s)
SELECT scan, CAST(beam AS INTEGER) AS beam, round(r, 6) AS r, round(r * cos(-2.35 + beam * 0.075), 6) AS x, round(r * sin(-2.35 + beam * 0.075), 6) AS y FROM b WHERE r BETWEEN 0.5 AND 10""")
def beam_points(spark, d):
    lit = lambda v: F.lit(float(v))
    p = spatial.beam_points(beams(spark, d), "ranges", lit(-2.35), lit(0.075), lit(0.5), lit(10), ["scan"])
    return p.select("scan", "beam", r6("r", "r"), r6("x", "x"), r6("y", "y"))


@query(f"""WITH {LOG}, z AS (SELECT event_id, k * 4 AS u, (event_id % 120) * 4 AS v, value / 100.0::DOUBLE AS z FROM e), s AS (SELECT *, greatest(0.05::DOUBLE * 380 / z, 2.0::DOUBLE) AS l FROM z WHERE z BETWEEN 0.3 AND 4.5),
t AS (SELECT *, CASE WHEN l >= 256 THEN 256 WHEN l >= 128 THEN 128 WHEN l >= 64 THEN 64 WHEN l >= 32 THEN 32 WHEN l >= 16 THEN 16 WHEN l >= 8 THEN 8 WHEN l >= 4 THEN 4 ELSE 2 END AS stride FROM s)
SELECT event_id, CAST(stride AS INTEGER) AS stride, round((u - 320) * z / 380, 6) AS x, round((v - 240) * z / 380, 6) AS y FROM t WHERE u % stride = 0 AND v % stride = 0""")
def pinhole_backproject(spark, d):
    pixels = log(spark, d).select("event_id", (F.col("k") * 4).alias("u"), (F.col("event_id") % 120 * 4).alias("v"), (F.col("value") / 100.0).alias("z"))
    p = spatial.back_project(pixels, "u", "v", "z", {"fx": 380.0, "fy": 380.0, "cx": 320.0, "cy": 240.0}, 0.3, 4.5, 0.05, 2)
    return p.select("event_id", F.col("stride").cast("int").alias("stride"), r6("x", "x"), r6("y", "y"))


@query(f"""WITH {PLANAR} SELECT event_id, round(1.5 + cos(0.3::DOUBLE) * x - sin(0.3::DOUBLE) * y, 6) AS x, round(-0.5 + sin(0.3::DOUBLE) * x + cos(0.3::DOUBLE) * y, 6) AS y, round(z + 0.2, 6) AS z FROM p""")
def rigid_transform(spark, d):
    pose = geo.literal_pose(1.5, -0.5, 0.2, yaw=0.3)
    p = planar(spark, d).withColumn("q", geo.transform_point(pose, geo.vector(F.col("x"), F.col("y"), F.col("z"))))
    return p.select("event_id", r6("q.x", "x"), r6("q.y", "y"), r6("q.z", "z"))


_VOXELS = PLANAR + """, v AS (SELECT run_id % 5 AS map, CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor((y - 5) / 0.5) AS BIGINT) AS iy, CAST(floor(z / 0.5) AS BIGINT) AS iz, value / 490.02 - 0.5 AS obs FROM p)"""


def _voxels(spark, d):
    cell = {f"i{a}": voxel.index(F.col(a) - (5 if a == "y" else 0), 0.5) for a in voxel.AXES}
    return planar(spark, d).withColumns(cell | {"map": F.col("run_id") % 5, "obs": F.col("value") / 490.02 - 0.5})


@query(f"WITH {_VOXELS} SELECT map, ix, iy, iz, round(avg(obs), 6) AS tsdf, count(*) AS weight FROM v GROUP BY ALL")
def voxel_mean(spark, d):
    return voxel.fused(_voxels(spark, d), ["map", "ix", "iy", "iz"]).select("map", "ix", "iy", "iz", r6("tsdf", "tsdf"), "weight")


@query(f"WITH {_VOXELS}, b AS (SELECT DISTINCT map, ix >> 3 AS bx, iy >> 3 AS by_, iz >> 3 AS bz FROM v) SELECT map, count(*) * 512 AS voxels FROM b GROUP BY map")
def block_count(spark, d):
    return voxel.blocks_allocated(_voxels(spark, d), ["map"])


@query(f"""WITH {PLANAR}, c AS (SELECT run_id % 5 AS map, CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor((y - 5) / 0.5) AS BIGINT) AS iy, stamp_ns, event_id, (value / 490.02 - 0.5) * 255 AS c FROM p),
n AS (SELECT map, ix, iy, c, row_number() OVER (w ORDER BY stamp_ns, event_id) AS i, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY map, ix, iy)),
m AS (SELECT map, ix, iy, sum(c * CASE WHEN n <= 33 THEN 1 / n::DOUBLE ELSE (32 / 33::DOUBLE) ** (n - greatest(i, 33)) / 33 END) AS c FROM n GROUP BY ALL)
SELECT map, ix, iy, round(c, 4) AS red, CAST(floor(c + 0.5) AS BIGINT) AS shown FROM m""")
def colour_mean_capped(spark, d):
    """In order of time; the weight of what was seen before stops at 32."""
    v = _voxels(spark, d).withColumn("c", F.col("obs") * 255)
    c = voxel.capped_mean(v, ["map", "ix", "iy"], "c", 32, ["stamp_ns", "event_id"])
    return c.select("map", "ix", "iy", F.round("mean", 4).alias("red"), F.floor(F.col("mean") + 0.5).alias("shown"))


@query(f"WITH {_VOXELS}, m AS (SELECT map, ix, iy, iz, avg(obs) AS tsdf FROM v GROUP BY ALL) SELECT map, ix, iy, iz, round(tsdf, 6) AS tsdf FROM m WHERE abs(tsdf) < 0.05")
def surface_filter(spark, d):
    return voxel.surface(voxel.fused(_voxels(spark, d), ["map", "ix", "iy", "iz"]), 0.05).select("map", "ix", "iy", "iz", r6("tsdf", "tsdf"))


@query(f"WITH {PLANAR} SELECT run_id, round(avg(CASE WHEN least(abs(x - 0), abs(x - 9), abs(y - 0), abs(y - 10)) > 1.5 THEN 1 ELSE 0 END), 6) AS ghosts FROM p GROUP BY run_id")
def ghost_fraction(spark, d):
    return voxel.ghost_fraction(planar(spark, d), ["run_id"], (0, 9, 0, 10), 1.5).select("run_id", r6("ghosts", "ghosts"))


@query(f"""WITH {PLANAR}, m AS (SELECT a.event_id, b.event_id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.topic = 'error' AND b.topic = 'view' AND a.run_id = b.run_id
AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d2, other) AS rank FROM m)
SELECT event_id, other, round(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def grid_two_nn(spark, d):
    p = planar(spark, d)
    refs = p.where("topic = 'view'").select("run_id", F.col("event_id").alias("other"), "x", "y")
    found = spatial.nearest_in_grid(p.where("topic = 'error'"), refs, "event_id", "other", 1.0, 2, ["run_id"])
    return found.select("event_id", "other", r6("d2", "d2"), "rank")


_RESIDUALS = PLANAR + ", r AS (SELECT run_id, event_id, sin(x) AS nx, cos(x) AS ny, x AS px, y AS py, (x - 5) / 10 AS res FROM p)"


def _residuals(spark, d):
    return planar(spark, d).select("run_id", "event_id", F.sin("x").alias("nx"), F.cos("x").alias("ny"), F.col("x").alias("px"), F.col("y").alias("py"), ((F.col("x") - 5) / 10).alias("res"))


@query(f"""WITH {_RESIDUALS}, t AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY abs(res), event_id) AS k FROM r)
SELECT run_id, count(*) AS used, round(sum(abs(res)) / count(*), 6) AS mean_residual FROM t WHERE k <= floor(n * (1 - 0.2)) GROUP BY run_id""")
def trimmed_residual(spark, d):
    t = stats.trimmed(_residuals(spark, d), ["run_id"], "res", "event_id")
    return t.groupBy("run_id").agg(F.count("*").alias("used"), r6(F.sum(F.abs("res")) / F.count("*"), "mean_residual"))


@query(f"""WITH {_RESIDUALS}, j AS (SELECT *, ny * px - nx * py AS nt FROM r)
SELECT run_id, round(sum(nx * nx), 4) AS h00, round(sum(nx * ny), 4) AS h01, round(sum(nx * nt), 4) AS h02, round(sum(ny * ny), 4) AS h11, round(sum(ny * nt), 4) AS h12, round(sum(nt * nt), 4) AS h22,
round(sum(nx * res), 4) AS g0, round(sum(ny * res), 4) AS g1, round(sum(nt * res), 4) AS g2 FROM j GROUP BY run_id""")
def normal_equations(spark, d):
    h = stats.normal_equations(_residuals(spark, d), ["run_id"], "nx", "ny", "px", "py", "res")
    return h.select("run_id", *[F.round(c, 4).alias(c) for c in h.columns if c != "run_id"])


@query(f"""WITH {_RESIDUALS}, h AS (SELECT run_id, sum(nx * nx) AS a, sum(nx * ny) AS b, sum(ny * ny) AS c FROM r GROUP BY run_id),
l AS (SELECT *, atan2(2 * b, a - c) / 2 AS strong, sqrt((a - c) * (a - c) + 4 * b * b) AS apart FROM h)
SELECT run_id, CASE WHEN a + c - apart <= 0.6 * (a + c + apart) THEN round(-sin(strong), 6) END AS wx, CASE WHEN a + c - apart <= 0.6 * (a + c + apart) THEN round(cos(strong), 6) END AS wy FROM l""")
def weak_direction(spark, d):
    h = stats.normal_equations(_residuals(spark, d), ["run_id"], "nx", "ny", "px", "py", "res")
    x, y = stats.weak_direction(F.col("h00"), F.col("h01"), F.col("h11"), 0.6)
    return h.select("run_id", r6(x, "wx"), r6(y, "wy"))


_TURN = "q.th + s.dtheta - a.ath"


@query(f"""WITH {PLANAR}, q AS (SELECT *, k / 20.0::DOUBLE AS th FROM p WHERE topic = 'purchase'), a AS (SELECT run_id, event_id AS anchor, x AS ax, y AS ay, k / 20.0::DOUBLE AS ath FROM p WHERE topic = 'error'),
o AS (SELECT unnest([-1, 0, 1]) AS v), s AS (SELECT CAST(9 * i.v + 3 * j.v + l.v + 13 AS INTEGER) AS seed, i.v * 0.5::DOUBLE AS dx, j.v * 0.5::DOUBLE AS dy, l.v * 0.12::DOUBLE AS dtheta FROM o i, o j, o l),
e2 AS (SELECT q.event_id, a.anchor, s.*, q.x + s.dx - a.ax AS ex, q.y + s.dy - a.ay AS ey, CASE WHEN {_TURN} > pi() THEN {_TURN} - 2 * pi() WHEN {_TURN} <= -pi() THEN {_TURN} + 2 * pi() ELSE {_TURN} END AS et
       FROM q JOIN a ON q.run_id = a.run_id AND sqrt((q.x - a.ax) * (q.x - a.ax) + (q.y - a.ay) * (q.y - a.ay)) <= 1.0, s),
m AS (SELECT *, exp(-(ex * ex + ey * ey + et * et)) AS score FROM e2), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, anchor, seed) AS n FROM m)
SELECT event_id, anchor, seed, dx, dy, dtheta, round(score, 6) AS score FROM r WHERE n = 1""")
def radius_seed_join(spark, d):
    """All runs, each within itself, with all 27 seeds."""
    p = planar(spark, d).withColumn("th", F.col("k") / 20.0)
    anchors = p.where("topic = 'error'").select("run_id", F.col("event_id").alias("anchor"), "x", "y", F.col("th").alias("ath"))
    near = spatial.within_radius(p.where("topic = 'purchase'").select("run_id", "event_id", "x", "y", "th"), anchors, 1.0, ["run_id"])
    seeds = F.explode(F.array(*[F.struct(F.lit(n).alias("seed"), F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(t).alias("dtheta")) for n, a, b, t in spatial.seeds(0.5, 0.12)])).alias("s")
    m = near.select("event_id", "anchor", "x", "y", "th", "ax", "ay", "ath", seeds).select("*", "s.*")
    ex, ey, et = F.col("x") + F.col("dx") - F.col("ax"), F.col("y") + F.col("dy") - F.col("ay"), geo.wrap_angle(F.col("th") + F.col("dtheta") - F.col("ath"))
    best = Window.partitionBy("event_id").orderBy(F.desc(F.round("score", 9)), "anchor", "seed")
    return m.withColumn("score", F.exp(-(ex * ex + ey * ey + et * et))).withColumn("n", F.row_number().over(best)).where("n = 1").select("event_id", "anchor", "seed", "dx", "dy", "dtheta", r6("score", "score"))


def _rays(spark, d):
    rays = read(spark, d, "embeddings").select(F.col("vec_id").alias("scan"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("beam"))
    return rays.withColumns({"ox": F.col("scan") % 10 * 0.1, "oy": F.col("scan") % 7 * 0.1, "dx": F.cos(F.col("beam") * 0.4), "dy": F.sin(F.col("beam") * 0.4)})


@query("""WITH b AS (SELECT vec_id AS scan, unnest(range(16)) AS beam FROM embeddings), c AS (SELECT DISTINCT (p_partkey % 11) - 5.0 AS cx, (p_partkey % 7) - 3.0 AS cy, 0.33 + (p_partkey % 3) * 0.1 AS rad FROM part),
r AS (SELECT scan, beam, (scan % 10) * 0.1::DOUBLE AS ox, (scan % 7) * 0.1::DOUBLE AS oy, cos(beam * 0.4::DOUBLE) AS dx, sin(beam * 0.4::DOUBLE) AS dy FROM b),
m AS (SELECT scan, beam, (ox - cx) * dx + (oy - cy) * dy AS k, (ox - cx) * (ox - cx) + (oy - cy) * (oy - cy) - rad * rad AS c FROM r, c),
t AS (SELECT scan, beam, CASE WHEN k * k - c < 0 THEN NULL WHEN -k - sqrt(k * k - c) > 0 THEN -k - sqrt(k * k - c) WHEN -k + sqrt(k * k - c) > 0 THEN -k + sqrt(k * k - c) END AS d FROM m)
SELECT scan, CAST(beam AS INTEGER) AS beam, round(min(d), 6) AS d FROM t GROUP BY scan, beam""")
def ray_obstacle_min(spark, d):
    """All parts as obstacles: however many, they are 231 different circles at most, which every ray meets.

    No ray starts on one: rounding would decide its distance.
    """
    n = F.col("p_partkey")
    circles = read(spark, d, "part").select((n % 11 - F.lit(5.0)).alias("x"), (n % 7 - F.lit(3.0)).alias("y"), (F.lit(0.33) + n % 3 * 0.1).alias("r")).distinct()
    met = _rays(spark, d).crossJoin(F.broadcast(circles))
    hits = met.groupBy("scan", "beam").agg(F.min(spatial.ray_circle(*[F.col(c) for c in ("ox", "oy", "dx", "dy", "x", "y", "r")])).alias("d"))
    return hits.select("scan", "beam", r6(F.when(F.col("d") < float("inf"), F.col("d")), "d"))


@query(f"""WITH {LOG} SELECT topic, round(quantile_disc(value, 0.5) / 1000, 6) AS p50, round(quantile_disc(value, 0.95) / 1000, 6) AS p95, round(quantile_disc(value, 0.99) / 1000, 6) AS p99, round(max(value) / 1000, 6) AS max, round(avg(value) / 1000, 6) AS mean FROM e GROUP BY topic""")
def latency_stats(spark, d):
    s = stats.latency_stats(log(spark, d), ["topic"], "value")
    return s.select("topic", *[r6(c, c) for c in s.columns if c != "topic"])


@query(f"""WITH {LOG}, t AS (SELECT run_id, count(*) AS n, (max(stamp_ns) - min(stamp_ns)) * 1e-9::DOUBLE AS span_s, sum(value) AS w FROM e GROUP BY run_id)
SELECT run_id, n, round(span_s, 4) AS span_s, round(CASE WHEN w > 0 THEN n / w ELSE 0 END, 6) AS throughput_hz, round(CASE WHEN w > 0 THEN span_s / w ELSE 0 END, 4) AS real_time_factor FROM t""")
def throughput_rtf(spark, d):
    t = stats.throughput(log(spark, d), ["run_id"], "stamp_ns", F.sum("value"))
    return t.select("run_id", "n", F.round("span_s", 4).alias("span_s"), r6("throughput_hz", "throughput_hz"), F.round("real_time_factor", 4).alias("real_time_factor"))


@query(f"""WITH {LOG}, n AS (SELECT run_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'NaN'::DOUBLE ELSE value END AS v FROM e)
SELECT run_id, round(avg(v) FILTER (WHERE NOT isnan(v)), 6) AS mean, round(stddev_pop(v) FILTER (WHERE NOT isnan(v)), 6) AS std FROM n GROUP BY run_id""")
def mean_std_nan(spark, d):
    e = log(spark, d).withColumn("v", F.when(F.col("k") % 5 == 1, float("nan")).when(F.col("k") % 5 != 0, F.col("value")))
    return stats.mean_std(e, ["run_id"], "v").select("run_id", r6("mean", "mean"), r6("std", "std"))


_PAIRS = PLANAR + ", a AS (SELECT run_id, event_id, x + 0.1 * sin(k) AS ex, y - 0.1 * cos(k) AS ey, z + 0.05 AS ez, x, y, z FROM p)"


def _pairs(spark, d):
    p = planar(spark, d)
    return p.withColumns({"ex": F.col("x") + 0.1 * F.sin("k"), "ey": F.col("y") - 0.1 * F.cos("k"), "ez": F.col("z") + 0.05})


@query(f"WITH {_PAIRS} SELECT run_id, round(sqrt(avg((ex - x) * (ex - x) + (ey - y) * (ey - y) + (ez - z) * (ez - z))), 6) AS rmse FROM a GROUP BY run_id")
def ate_unaligned(spark, d):
    return stats.absolute_error(_pairs(spark, d), ["run_id"], ["ex", "ey", "ez"], ["x", "y", "z"]).select("run_id", r6("rmse", "rmse"))


#: The best rotation between centred points, as the unit vector that a 4 x 4 matrix of their products stretches most: found by
#: squaring the matrix 40 times. Runs whose points lie on a line are not turned, nor moved.
_ALIGNED = f"""{_PAIRS}, c AS (SELECT *, ex - avg(ex) OVER r AS ax, ey - avg(ey) OVER r AS ay, ez - avg(ez) OVER r AS az, x - avg(x) OVER r AS bx, y - avg(y) OVER r AS by_, z - avg(z) OVER r AS bz FROM a WINDOW r AS (PARTITION BY run_id)),
s AS (SELECT run_id, avg(ax * bx) AS xx, avg(ax * by_) AS xy, avg(ax * bz) AS xz, avg(ay * bx) AS yx, avg(ay * by_) AS yy, avg(ay * bz) AS yz, avg(az * bx) AS zx, avg(az * by_) AS zy, avg(az * bz) AS zz FROM c GROUP BY run_id),
n AS (SELECT *, xx * xx + xy * xy + xz * xz + yx * yx + yy * yy + yz * yz + zx * zx + zy * zy + zz * zz AS whole, (xx * yy - xy * yx) ** 2 + (xx * yz - xz * yx) ** 2 + (xy * yz - xz * yy) ** 2 + (xx * zy - xy * zx) ** 2 + (xx * zz - xz * zx) ** 2 + (xy * zz - xz * zy) ** 2 + (yx * zy - yy * zx) ** 2 + (yx * zz - yz * zx) ** 2 + (yy * zz - yz * zy) ** 2 AS minors FROM s),
m AS (SELECT run_id, minors > 1e-24 * whole AS turns, sqrt(3 * whole) + 1e-300 AS k, [xx + yy + zz, yz - zy, zx - xz, xy - yx, yz - zy, xx - yy - zz, xy + yx, zx + xz, zx - xz, xy + yx, yy - xx - zz, yz + zy, xy - yx, zx + xz, yz + zy, zz - xx - yy] AS m FROM n),
g AS (SELECT run_id, turns, list_transform(range(16), lambda i: m[i + 1] / k + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END) AS m FROM m),
h AS (SELECT run_id, turns, list_reduce(list_transform(range(41), lambda i: m), lambda u, e: list_transform(range(16), lambda i: (u[i // 4 * 4 + 1] * u[i % 4 + 1] + u[i // 4 * 4 + 2] * u[i % 4 + 5] + u[i // 4 * 4 + 3] * u[i % 4 + 9] + u[i // 4 * 4 + 4] * u[i % 4 + 13]) / (u[1] * u[1] + u[6] * u[6] + u[11] * u[11] + u[16] * u[16] + 2 * (u[2] * u[2] + u[3] * u[3] + u[4] * u[4] + u[7] * u[7] + u[8] * u[8] + u[12] * u[12])))) AS p FROM g),
j AS (SELECT *, CASE greatest(p[1], p[6], p[11], p[16]) WHEN p[1] THEN 0 WHEN p[6] THEN 4 WHEN p[11] THEN 8 ELSE 12 END AS o FROM h), q AS (SELECT run_id, turns, p[o + 1] / sqrt(p[o // 4 * 5 + 1]) AS qw, p[o + 2] / sqrt(p[o // 4 * 5 + 1]) AS qx, p[o + 3] / sqrt(p[o // 4 * 5 + 1]) AS qy, p[o + 4] / sqrt(p[o // 4 * 5 + 1]) AS qz FROM j),
t AS (SELECT c.run_id, turns, ex - x AS ux, ey - y AS uy, ez - z AS uz, (1 - 2 * (qy * qy + qz * qz)) * ax + 2 * (qx * qy - qw * qz) * ay + 2 * (qx * qz + qw * qy) * az - bx AS dx, 2 * (qx * qy + qw * qz) * ax + (1 - 2 * (qx * qx + qz * qz)) * ay + 2 * (qy * qz - qw * qx) * az - by_ AS dy, 2 * (qx * qz - qw * qy) * ax + 2 * (qy * qz + qw * qx) * ay + (1 - 2 * (qx * qx + qy * qy)) * az - bz AS dz FROM c JOIN q USING (run_id)),
e2 AS (SELECT run_id, CASE WHEN turns THEN dx * dx + dy * dy + dz * dz ELSE ux * ux + uy * uy + uz * uz END AS d2 FROM t) SELECT run_id, round(sqrt(avg(d2)), 6) AS rmse, round(sqrt(max(d2)), 6) AS max FROM e2 GROUP BY run_id"""


@query(f"WITH {_ALIGNED}")
def ate_aligned(spark, d):
    return stats.absolute_error(_pairs(spark, d), ["run_id"], ["ex", "ey", "ez"], ["x", "y", "z"], align=True).select("run_id", r6("rmse", "rmse"), r6("max", "max"))


@query(f"WITH {LOG} SELECT topic, round(sqrt(avg(value * value)), 6) AS rmse, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM e GROUP BY topic")
def error_stats(spark, d):
    s = stats.error_stats(log(spark, d), ["topic"], "value")
    return s.select("topic", *[r6(c, c) for c in ("rmse", "mean", "median", "std")], "min", "max")


_W = "(PARTITION BY run_id ORDER BY stamp_ns, event_id)"
_UPTO = "(PARTITION BY run_id ORDER BY stamp_ns, event_id ROWS UNBOUNDED PRECEDING)"
_BEFORE = "(PARTITION BY run_id ORDER BY stamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {PLANAR}, s AS (SELECT run_id, sqrt((x - lag(x) OVER {_W}) ** 2 + (y - lag(y) OVER {_W}) ** 2 + (z - lag(z) OVER {_W}) ** 2) AS d FROM p) SELECT run_id, round(sum(coalesce(d, 0)), 5) AS length FROM s GROUP BY run_id")
def path_length(spark, d):
    return temporal.path_length(planar(spark, d), ["run_id"], ["stamp_ns", "event_id"], ["x", "y", "z"]).select("run_id", F.round("length", 5).alias("length"))


@query(f"""WITH {PLANAR}, s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER {_W}) ** 2 + (y - lag(y) OVER {_W}) ** 2), 0) AS d FROM p), c AS (SELECT *, sum(d) OVER {_W} AS along FROM s),
g AS (SELECT *, floor(round(along, 9) / 10) AS seg FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY run_id, seg ORDER BY stamp_ns, event_id) AS n FROM g),
q AS (SELECT run_id, event_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM f WHERE n = 1 WINDOW w AS (PARTITION BY run_id ORDER BY seg))
SELECT run_id, count(*) AS pairs, round(avg(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 5) AS mean_step FROM q WHERE nx IS NOT NULL GROUP BY run_id""")
def rpe_pairs(spark, d):
    q = stats.relative_pairs(planar(spark, d), ["run_id"], ["stamp_ns", "event_id"], ["x", "y"], 10.0)
    return q.groupBy("run_id").agg(F.count("*").alias("pairs"), F.round(F.avg(F.hypot(F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y"))), 5).alias("mean_step"))


@query(f"""WITH {PLANAR}, f AS (SELECT *, k / 20.0::DOUBLE AS th, first_value(x) OVER {_W} AS x0, first_value(y) OVER {_W} AS y0, first_value(k / 20.0::DOUBLE) OVER {_W} AS t0 FROM p)
SELECT event_id, round(cos(t0) * (x - x0) + sin(t0) * (y - y0), 5) + 0.0 AS rx, round(cos(t0) * (y - y0) - sin(t0) * (x - x0), 5) + 0.0 AS ry, round(CASE WHEN th - t0 > pi() THEN th - t0 - 2 * pi() WHEN th - t0 <= -pi() THEN th - t0 + 2 * pi() ELSE th - t0 END, 5) + 0.0 AS rtheta FROM f""")
def odom_reanchor(spark, d):
    p = planar(spark, d).withColumn("th", F.col("k") / 20.0)
    a = temporal.reanchored(p, ["run_id"], ["stamp_ns", "event_id"], "x", "y", "th")
    return a.select("event_id", r5z("rx", "rx"), r5z("ry", "ry"), r5z("rtheta", "rtheta"))


@query(f"""WITH {PLANAR}, t AS (SELECT *, x / 10 AS dx, y / 100 AS dy, (k - 50) / 100.0::DOUBLE AS dt FROM p),
u AS (SELECT *, sum(dt) OVER w AS theta, coalesce(sum(dt) OVER (PARTITION BY run_id ORDER BY stamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t WINDOW w AS (PARTITION BY run_id ORDER BY stamp_ns, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, cos(b) * dx - sin(b) * dy AS mx, sin(b) * dx + cos(b) * dy AS my FROM u)
SELECT event_id, round(theta, 5) + 0.0 AS theta, round(sum(mx) OVER w, 5) + 0.0 AS px, round(sum(my) OVER w, 5) + 0.0 AS py FROM m WINDOW w AS (PARTITION BY run_id ORDER BY stamp_ns, event_id ROWS UNBOUNDED PRECEDING)""")
def odom_integrate(spark, d):
    p = planar(spark, d).select("event_id", "run_id", "stamp_ns", (F.col("x") / 10).alias("dx"), (F.col("y") / 100).alias("dy"), ((F.col("k") - 50) / 100.0).alias("dt"))
    i = temporal.integrated(p, ["run_id"], ["stamp_ns", "event_id"], "dx", "dy", "dt")
    return i.select("event_id", r5z("theta", "theta"), r5z("x", "px"), r5z("y", "py"))


@query(f"WITH {LOG}, s AS (SELECT *, k // 10 AS level FROM e), l AS (SELECT *, lag(level) OVER {_W} AS b FROM s) SELECT event_id, run_id, level FROM l WHERE b IS NULL OR b <> level")
def emit_on_change(spark, d):
    e = log(spark, d).withColumn("level", F.expr("cast(k div 10 as int)"))
    return temporal.on_change(e, "level", ["run_id"], ["stamp_ns", "event_id"]).select("event_id", "run_id", "level")


_TURNED = "abs(((o.theta - s.t + pi()) - 2 * pi() * floor((o.theta - s.t + pi()) / (2 * pi()))) - pi())"


@query(f"""WITH RECURSIVE {PLANAR}, o AS (SELECT run_id, stamp_ns, x, y, k / 20.0::DOUBLE AS theta, row_number() OVER {_W} AS n FROM p),
s(run_id, n, stamp_ns, x, y, t, kept) AS (SELECT run_id, n, stamp_ns, x, y, theta, true FROM o WHERE n = 1 UNION ALL
SELECT o.run_id, o.n, o.stamp_ns, CASE WHEN far THEN o.x ELSE o.kx END, CASE WHEN far THEN o.y ELSE o.ky END, CASE WHEN far THEN o.theta ELSE o.kt END, far FROM
(SELECT o.*, s.x AS kx, s.y AS ky, s.t AS kt, sqrt((o.x - s.x) ** 2 + (o.y - s.y) ** 2) > 3.0 OR {_TURNED} > 2.0 AS far FROM s JOIN o ON o.run_id = s.run_id AND o.n = s.n + 1) o)
SELECT run_id, stamp_ns, x, y, t AS theta FROM s WHERE kept""")
def keyframe_gate(spark, d):
    p = planar(spark, d).select("run_id", "stamp_ns", F.col("event_id").alias("seq"), "x", "y", (F.col("k") / 20.0).alias("theta"))
    return folds.folded(p, lambda: folds.Keyframes(3.0, 2.0), "run_id", ["stamp_ns", "seq"])


@query(f"""WITH RECURSIVE {LOG}, o AS (SELECT run_id, value, row_number() OVER {_W} AS n FROM e), s(run_id, n, v) AS (SELECT run_id, n, value FROM o WHERE n = 1
UNION ALL SELECT o.run_id, o.n, 0.8 * s.v + 0.2 * o.value FROM s JOIN o ON o.run_id = s.run_id AND o.n = s.n + 1) SELECT run_id, CAST(count(*) AS INTEGER) AS n, round(max_by(v, n), 6) AS state FROM s GROUP BY run_id""")
def exp_decay_state(spark, d):
    return folds.folded(log(spark, d), lambda: folds.Decay(0.8), "run_id", ["stamp_ns", "event_id"]).select("run_id", "n", r6("state", "state"))


@query(f"""WITH RECURSIVE {LOG}, o AS (SELECT run_id, stamp_ns, event_id, row_number() OVER {_W} AS n FROM e),
s(run_id, n, stamp_ns, seq, start, segment) AS (SELECT run_id, n, stamp_ns, event_id, stamp_ns, 0 FROM o WHERE n = 1 UNION ALL
SELECT o.run_id, o.n, o.stamp_ns, o.event_id, CASE WHEN o.stamp_ns - s.start >= 3600000000000 THEN o.stamp_ns ELSE s.start END, s.segment + CASE WHEN o.stamp_ns - s.start >= 3600000000000 THEN 1 ELSE 0 END FROM s JOIN o ON o.run_id = s.run_id AND o.n = s.n + 1)
SELECT run_id, stamp_ns, seq, CAST(segment AS INTEGER) AS segment FROM s""")
def segment_reset_5s(spark, d):
    e = log(spark, d).select("run_id", "stamp_ns", F.col("event_id").alias("seq"))
    return folds.folded(e, lambda: folds.Segments(3_600_000_000_000), "run_id", ["stamp_ns", "seq"])


@query(f"WITH {LOG} SELECT event_id, run_id, CAST((row_number() OVER {_W} - 1) // 10 AS INTEGER) AS chunk FROM e")
def chunk_of_n(spark, d):
    n = temporal.numbered(log(spark, d), ["run_id"], ["stamp_ns", "event_id"])
    return n.select("event_id", "run_id", F.expr("cast((pos - 1) div 10 as int)").alias("chunk"))


@query(f"WITH {LOG}, l AS (SELECT run_id, stamp_ns, lag(stamp_ns) OVER (PARTITION BY run_id ORDER BY event_id) AS b FROM e) SELECT run_id, bool_and(b IS NULL OR b <= stamp_ns) AS is_sorted FROM l GROUP BY run_id")
def is_sorted(spark, d):
    return temporal.sortedness(log(spark, d), ["run_id"], "stamp_ns", ["event_id"])


@query(f"""WITH {PLANAR}, f AS (SELECT *, row_number() OVER {_W} AS n, lead(x) OVER {_W} AS x1, lead(stamp_ns) OVER {_W} AS t1 FROM p)
SELECT run_id, stamp_ns, round(x, 6) AS x, round(CASE WHEN t1 > stamp_ns THEN (x1 - x) / ((t1 - stamp_ns) * 1e-9::DOUBLE) ELSE 0 END, 9) AS v_x FROM f WHERE n = 1""")
def finite_diff_velocity(spark, d):
    v = temporal.finite_difference(planar(spark, d), ["run_id"], "stamp_ns", ["stamp_ns", "event_id"], ["x"])
    return v.select("run_id", "stamp_ns", r6("x", "x"), F.round("v_x", 9).alias("v_x"))


_MATRIX = """WITH sys(system, needs) AS (VALUES ('stationary', 'click'), ('odometry', 'view'), ('scan', 'purchase')), s AS (SELECT DISTINCT user_id AS run_id, event_type AS topic FROM events WHERE user_id % 3 <> 1 OR event_type <> 'view'),
cells AS (SELECT r.run_id, system FROM (SELECT DISTINCT run_id FROM s) r, sys WHERE EXISTS (SELECT 1 FROM s WHERE s.run_id = r.run_id AND s.topic = sys.needs))"""


def _cells(spark, d):
    have = log(spark, d).where("run_id % 3 <> 1 or topic <> 'view'").select("run_id", "topic").distinct()
    needs = F.explode(F.array(*[F.struct(F.lit(a).alias("system"), F.lit(b).alias("topic")) for a, b in (("stationary", "click"), ("odometry", "view"), ("scan", "purchase"))]))
    return have.select("run_id").distinct().select("run_id", needs.alias("n")).select("run_id", "n.*").join(have, ["run_id", "topic"], "left_semi").select("run_id", "system")


@query(f"{_MATRIX} SELECT run_id, system FROM cells")
def system_matrix(spark, d):
    return _cells(spark, d)


@query(f"{_MATRIX} SELECT run_id, system FROM cells c WHERE NOT EXISTS (SELECT 1 FROM cells f WHERE f.run_id = c.run_id AND f.system = c.system AND f.run_id % 4 = 0 AND f.system <> 'scan')")
def resume_anti(spark, d):
    cells = _cells(spark, d)
    return cells.join(cells.where("run_id % 4 = 0 and system <> 'scan'"), ["run_id", "system"], "left_anti")


@query("""SELECT l_suppkey AS sequence, round(avg(CASE WHEN l_returnflag = 'A' THEN l_discount END), 6) AS A, round(avg(CASE WHEN l_returnflag = 'N' THEN l_discount END), 6) AS N, round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS R,
round(least(avg(CASE WHEN l_returnflag = 'A' THEN l_discount END), avg(CASE WHEN l_returnflag = 'N' THEN l_discount END), avg(CASE WHEN l_returnflag = 'R' THEN l_discount END)), 6) AS best FROM lineitem GROUP BY l_suppkey""")
def pivot_best(spark, d):
    p = stats.pivot_best(read(spark, d, "lineitem").withColumnRenamed("l_suppkey", "sequence"), "sequence", "l_returnflag", "l_discount", ["A", "N", "R"])
    return p.select("sequence", *[r6(c, c) for c in ("A", "N", "R", "best")])


@query("SELECT regexp_extract(p_name, '^[a-z]+') AS scene, p_type AS config, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY ALL")
def scene_mean(spark, d):
    return read(spark, d, "part").groupBy(F.regexp_extract("p_name", "^[a-z]+", 0).alias("scene"), F.col("p_type").alias("config")).agg(F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query(f"WITH {LOG} SELECT run_id, count(*) FILTER (WHERE topic = 'view') AS matched, count(*) FILTER (WHERE topic = 'error') AS coasted, count(*) FILTER (WHERE value < 50) AS degenerate FROM e GROUP BY run_id")
def health_counts(spark, d):
    count = lambda c, n: F.count_if(F.expr(c)).alias(n)
    return log(spark, d).groupBy("run_id").agg(count("topic = 'view'", "matched"), count("topic = 'error'", "coasted"), count("value < 50", "degenerate"))


@query(f"""WITH {LOG}, s AS (SELECT run_id, avg(value) AS m, count(*) AS n FROM e GROUP BY run_id) SELECT run_id, m < 250 AS mean_ok, n > 60 AS count_ok, m < 250 AND n > 60 AS passed FROM s""")
def gates(spark, d):
    s = log(spark, d).groupBy("run_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    g = s.select("run_id", (F.col("m") < 250).alias("mean_ok"), (F.col("n") > 60).alias("count_ok"))
    return g.withColumn("passed", F.col("mean_ok") & F.col("count_ok"))


_INTER = "greatest(0, least(b.x, o.x) + 1 - greatest(b.x, o.x) + 1) * greatest(0, least(b.y, o.y) + 1 - greatest(b.y, o.y) + 1)"


@query(f"""WITH RECURSIVE {PLANAR}, o AS (SELECT run_id, event_id AS id, value AS score, x, y, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, event_id) AS n FROM p),
s(run_id, n, id, score, kept, good) AS (SELECT run_id, n, id, score, [struct_pack(x := x, y := y)], true FROM o WHERE n = 1 UNION ALL
SELECT o.run_id, o.n, o.id, o.score, CASE WHEN len(list_filter(s.kept, lambda b: {_INTER} / (8 - {_INTER}) > 0.45)) = 0 THEN list_append(s.kept, struct_pack(x := o.x, y := o.y)) ELSE s.kept END,
len(list_filter(s.kept, lambda b: {_INTER} / (8 - {_INTER}) > 0.45)) = 0 FROM s JOIN o ON o.run_id = s.run_id AND o.n = s.n + 1) SELECT run_id, id, score FROM s WHERE good""")
def nms_greedy(spark, d):
    b = planar(spark, d).select("run_id", F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("x") - 1).alias("x0"), (F.col("y") - 1).alias("y0"), (F.col("x") + 1).alias("x1"), (F.col("y") + 1).alias("y1"))
    return spatial.suppressed(b, ["run_id"], ["score"], 0.45)


@query(f"WITH {LOG}, m AS (SELECT DISTINCT run_id, CAST(value AS INTEGER) // 10 AS u, k // 10 AS v FROM e), o AS (SELECT unnest(range(-1, 2)) AS i) SELECT DISTINCT run_id, CAST(u + a.i AS INTEGER) AS u, CAST(v + b.i AS INTEGER) AS v FROM m, o a, o b")
def dilate(spark, d):
    return _dilated(log(spark, d))


def _dilated(e):
    m = e.select("run_id", F.expr("cast(round(value) as int) div 10").cast("int").alias("u"), F.expr("k div 10").cast("int").alias("v"))
    return spatial.dilated(m, ["run_id"], "u", "v", 1)


@query("SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS best, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class FROM embeddings WHERE list_max(embedding) >= 0.25")
def class_threshold(spark, d):
    best = F.array_max("embedding")
    e = read(spark, d, "embeddings").where(best >= 0.25)
    return e.select("vec_id", r6(best.cast("double"), "best"), (F.array_position("embedding", best) - 1).cast("int").alias("class"))


@query("""WITH RECURSIVE t(id, depth, x) AS (SELECT 0, 0, 0.0::DOUBLE UNION ALL SELECT n_nationkey, depth + 1, x + n_regionkey * 0.5 FROM nation JOIN t ON n_nationkey > 0 AND (n_nationkey - 1) // 2 = t.id)
SELECT id, depth, round(x, 6) AS x FROM t""")
def rig_bfs(spark, d):
    edges = read(spark, d, "nation").where("n_nationkey > 0").select(F.expr("cast((n_nationkey - 1) div 2 as int)").alias("parent"), F.col("n_nationkey").alias("child"), (F.col("n_regionkey") * F.lit(0.5)).alias("x"))
    return flattened(edges).select("id", "depth", r6("x", "x"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) || '.' || substr('0123456789987', 1, CAST(l_linenumber AS INTEGER) * 2) AS text FROM lineitem)
SELECT text, l_orderkey * 1000000000 + CAST(rpad(substr(split_part(text, '.', 2), 1, 9), 9, '0') AS BIGINT) AS stamp_ns, CAST(l_orderkey AS VARCHAR) || '.' || rpad(substr(split_part(text, '.', 2), 1, 9), 9, '0') AS shown FROM s""")
def exact_stamp_parse(spark, d):
    return _parsed(read(spark, d, "lineitem"))


def _parsed(items):
    s = items.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.expr("substr('0123456789987', 1, l_linenumber * 2)")).alias("text"))
    return s.withColumn("stamp_ns", parse_stamp(F.col("text"))).withColumn("shown", format_stamp(F.col("stamp_ns")))


_K = str((1 << 40) - 87)


@query(f"""WITH {_VOXELS}, i AS (SELECT DISTINCT ix, iy, iz FROM v), a AS (SELECT *, (((ix % 1048576) + 1048576) % 1048576 * 2654435) % {_K} AS h FROM i), b AS (SELECT *, xor(h, h >> 13) AS h1 FROM a),
c AS (SELECT *, (h1 * 31 + ((iy % 1048576) + 1048576) % 1048576 * 2654435) % {_K} AS h2 FROM b), e2 AS (SELECT *, xor(h2, h2 >> 13) AS h3 FROM c), f AS (SELECT *, (h3 * 31 + ((iz % 1048576) + 1048576) % 1048576 * 2654435) % {_K} AS h4 FROM e2), g AS (SELECT *, xor(h4, h4 >> 13) AS h5 FROM f)
SELECT ix, iy, iz, h5 AS hash FROM g WHERE h5 % 4 = 0""")
def hash_decimate(spark, d):
    i = _voxels(spark, d).select("ix", "iy", "iz").distinct()
    return i.withColumn("hash", voxel.mixed_hash(F.col("ix"), F.col("iy"), F.col("iz"))).where("hash % 4 = 0")


@query(f"""WITH {PLANAR}, q AS (SELECT event_id, x AS px, y AS py, z AS pz, sqrt(x * x + y * y + z * z) AS dist FROM p), s AS (SELECT *, greatest(dist - 0.75, 0.0) AS a, dist + 0.75 AS b FROM q WHERE dist >= 1e-9),
w AS (SELECT *, unnest(range(0, CAST(floor((b - a) / 0.125) AS BIGINT) + 2)) AS step FROM s), v AS (SELECT *, least(a + step * 0.125, b) AS t FROM w),
i AS (SELECT event_id, step, CAST(floor(t * px / dist / 0.25) AS BIGINT) AS ix, CAST(floor(t * py / dist / 0.25) AS BIGINT) AS iy, CAST(floor(t * pz / dist / 0.25) AS BIGINT) AS iz, greatest(-0.75, least(0.75, dist - t)) AS obs FROM v),
l AS (SELECT *, lag(ix) OVER g AS jx, lag(iy) OVER g AS jy, lag(iz) OVER g AS jz FROM i WINDOW g AS (PARTITION BY event_id ORDER BY step))
SELECT event_id, CAST(step AS INTEGER) AS step, ix, iy, iz, round(obs, 6) AS obs FROM l WHERE jx IS NULL OR jx <> ix OR jy <> iy OR jz <> iz""")
def ray_integration(spark, d):
    return _integrated(planar(spark, d))


def _integrated(p):
    rays = p.select("event_id", *[F.lit(0.0).alias(f"o{a}") for a in voxel.AXES], *[F.col(a).alias(f"p{a}") for a in voxel.AXES])
    return voxel.ray_observations(rays, ["event_id"], 0.25, 0.75).withColumn("obs", F.round("obs", 6))


@query(f"""WITH {_VOXELS}, f AS (SELECT ix, iy, iz, avg(obs) AS t FROM v GROUP BY ALL), g AS (SELECT event_id, x / 0.5 - 0.5 AS gx, (y - 5) / 0.5 - 0.5 AS gy, z / 0.5 - 0.5 AS gz FROM p),
o AS (SELECT unnest([0, 1]) AS v), c AS (SELECT event_id, i.v AS bx, j.v AS by_, k.v AS bz, CAST(floor(gx) AS BIGINT) + i.v AS ix, CAST(floor(gy) AS BIGINT) + j.v AS iy, CAST(floor(gz) AS BIGINT) + k.v AS iz, gx - floor(gx) AS fx, gy - floor(gy) AS fy, gz - floor(gz) AS fz FROM g, o i, o j, o k),
l AS (SELECT event_id, bz, any_value(fz) AS fz, count(t) AS n, sum((CASE WHEN bx = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN by_ = 1 THEN fy ELSE 1 - fy END) * t) AS s FROM c LEFT JOIN f USING (ix, iy, iz) GROUP BY event_id, bz),
m AS (SELECT event_id, any_value(fz) AS fz, max(CASE WHEN bz = 0 AND n = 4 THEN s END) AS lo, max(CASE WHEN bz = 1 AND n = 4 THEN s END) AS hi FROM l GROUP BY event_id)
SELECT event_id, round(CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo * (1 - fz) + hi * fz ELSE coalesce(lo, hi) END, 6) AS sdf FROM m""")
def trilinear_sample(spark, d):
    """Every point, null where no layer of four voxels is known."""
    v = voxel.fused(_voxels(spark, d), ["ix", "iy", "iz"])
    return voxel.gradients(planar(spark, d).withColumn("y", F.col("y") - 5), v, "event_id", 0.5).select("event_id", r6("sdf", "sdf"))


@query(f"""WITH {LOG}, t AS (SELECT event_id, run_id, stamp_ns, k / 1e6 AS g, value / 1e6 AS f, coalesce((stamp_ns - lag(stamp_ns) OVER {_W}) * 1e-9::DOUBLE, 0) AS dt FROM e),
a AS (SELECT *, coalesce(sum(g * dt) OVER {_BEFORE}, 0) AS b, sum(g * dt) OVER {_UPTO} AS yaw FROM t), c AS (SELECT *, cos(b) * f AS ax, sin(b) * f AS ay FROM a),
v AS (SELECT *, coalesce(sum(ax * dt) OVER {_BEFORE}, 0) AS vx, coalesce(sum(ay * dt) OVER {_BEFORE}, 0) AS vy FROM c),
s AS (SELECT *, sum(vx * dt + ax * dt * dt / 2) OVER {_UPTO} AS tx, sum(vy * dt + ay * dt * dt / 2) OVER {_UPTO} AS ty FROM v)
SELECT run_id, stamp_ns, round(tx / 1000, 4) + 0.0 AS tx, round(ty / 1000, 4) + 0.0 AS ty, round(sin(yaw), 4) + 0.0 AS sine, round(cos(yaw), 4) + 0.0 AS cosine FROM s""")
def dead_reckoning(spark, d):
    """Turning about the vertical only, for which the SQL has a closed form; distances in kilometres."""
    e = log(spark, d).select("run_id", "stamp_ns", F.col("event_id").alias("seq"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), (F.col("k") / 1e6).alias("gz"), (F.col("value") / 1e6).alias("ax"), F.lit(0.0).alias("ay"), F.lit(folds.GRAVITY).alias("az"))
    p = folds.folded(e, folds.DeadReckoning, "run_id", ["stamp_ns", "seq"])
    four = lambda c, n: (F.round(c, 4) + F.lit(0.0)).alias(n)
    return p.select("run_id", "stamp_ns", four(F.col("tx") / 1000, "tx"), four(F.col("ty") / 1000, "ty"), four(2 * F.col("qz") * F.col("qw"), "sine"), four(1 - 2 * F.col("qz") * F.col("qz"), "cosine"))


@query(f"""WITH RECURSIVE {LOG}, o AS (SELECT run_id, stamp_ns, k / 1e3 AS g, sin(k / 100.0::DOUBLE) AS ax, row_number() OVER {_W} AS n, least(greatest(coalesce((stamp_ns - lag(stamp_ns) OVER {_W}) * 1e-9::DOUBLE, 0), 0), 0.1) AS dt FROM e),
f AS (SELECT *, sqrt(ax * ax + 0.01 + 94.09) AS size FROM o), s(run_id, n, stamp_ns, x, y, z, ready) AS (SELECT run_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, false FROM f WHERE n = 1 UNION ALL
SELECT run_id, n, stamp_ns, CASE WHEN sine >= 1e-12 THEN (sin((1 - share) * arc) * x + sin(share * arc) * fx) / sine ELSE x END, CASE WHEN sine >= 1e-12 THEN (sin((1 - share) * arc) * y + sin(share * arc) * fy) / sine ELSE y END, CASE WHEN sine >= 1e-12 THEN (sin((1 - share) * arc) * z + sin(share * arc) * fz) / sine ELSE z END, true FROM
(SELECT *, sqrt((y * fz - z * fy) ** 2 + (z * fx - x * fz) ** 2 + (x * fy - y * fx) ** 2) AS sine, atan2(sqrt((y * fz - z * fy) ** 2 + (z * fx - x * fz) ** 2 + (x * fy - y * fx) ** 2), x * fx + y * fy + z * fz) AS arc FROM
(SELECT f.run_id, f.n, f.stamp_ns, s.x, cos(f.g * f.dt) * s.y + sin(f.g * f.dt) * s.z AS y, cos(f.g * f.dt) * s.z - sin(f.g * f.dt) * s.y AS z, f.ax / f.size AS fx, 0.1 / f.size AS fy, 9.7 / f.size AS fz, CASE WHEN s.ready THEN least(0.5 * f.dt, 1) ELSE 1 END AS share
FROM s JOIN f ON f.run_id = s.run_id AND f.n = s.n + 1)))
SELECT run_id, stamp_ns, round(atan2(y, z), 5) + 0.0 AS roll, round(asin(greatest(-1, least(1, -x))), 5) + 0.0 AS pitch, ready AS initialised FROM s WHERE n > 0""")
def attitude_filter(spark, d):
    """Every force here is near enough to gravity to be taken."""
    e = log(spark, d).select("run_id", "stamp_ns", F.col("event_id").alias("seq"), (F.col("k") / 1e3).alias("gx"), F.lit(0.0).alias("gy"), F.lit(0.0).alias("gz"), F.sin(F.col("k") / 100).alias("ax"), F.lit(0.1).alias("ay"), F.lit(9.7).alias("az"))
    t = folds.folded(e, folds.Tilt, "run_id", ["stamp_ns", "seq"])
    return t.select("run_id", "stamp_ns", r5z("roll", "roll"), r5z("pitch", "pitch"), "initialised")


@query("""WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS roll, embedding[2]::DOUBLE AS pitch, embedding[3]::DOUBLE * 4 AS yaw FROM embeddings)
SELECT vec_id, round(roll, 6) AS roll, round(pitch, 6) AS pitch, round(yaw, 6) AS yaw FROM q""")
def rotation_round_trip(spark, d):
    a = [F.col("embedding")[k].cast("double") * (4 if k == 2 else 1) for k in range(3)]
    e = read(spark, d, "embeddings").select("vec_id", geo.from_rpy(*a).alias("q")).withColumn("w", geo.q_log(F.col("q")))
    e = e.withColumn("q", geo.q_exp(F.col("w.x"), F.col("w.y"), F.col("w.z"))).withColumn("r", geo.to_rpy(F.col("q")))
    return e.select("vec_id", *[r6(f"r.{k}", k) for k in ("roll", "pitch", "yaw")])


@query("""WITH t AS (SELECT event_id, 2 * pi() / 10 * (event_id % 4001) / 200.0::DOUBLE AS a FROM events) SELECT event_id, round(1.5 * (1 - cos(a)), 5) + 0.0 AS px, round(1.5 * (2 * pi() / 10) ** 2 * cos(a), 5) + 0.0 AS ax FROM t""")
def synthetic_trajectory(spark, d):
    """Where a body on an even swing is at each event, and its acceleration."""
    w = 2 * math.pi / 10
    t = F.col("event_id") % 4001 / 200.0
    return read(spark, d, "events").select("event_id", r5z(1.5 * (1 - F.cos(w * t)), "px"), r5z(1.5 * w**2 * F.cos(w * t), "ax"))


#: Names that these queries had while others of their name read some ids only.
for _name, _old in (("radius_seed_join", "radius_seed_join_all"), ("ray_obstacle_min", "ray_obstacle_min_all"), ("dilate", "dilate_all"), ("exact_stamp_parse", "exact_stamp_parse_all"), ("ray_integration", "ray_integration_all"), ("colour_mean_capped", "colour_mean_folded")):
    QUERIES[_old], ORACLE_SQL[_old] = QUERIES[_name], ORACLE_SQL[_name]
