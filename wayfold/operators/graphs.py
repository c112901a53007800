"""Factor graphs of any size, solved by Spark: sparse normal equations, eliminated block by block, the rest by conjugate gradients.

A graph's variables are numbered along its run, so that neighbours have near numbers. Each factor gives, at the current values, an
*element*: a small dense matrix and a gradient over the variables it touches. Elements whose variables lie in one block of numbers meet in a
task, which eliminates the variables that no other element touches and leaves one element over the others. Blocks grow by
level until a graph is one block, so chains of any length go in a few levels. Where what is left of a block would be too large for a task, the
remaining equations are solved by preconditioned conjugate gradients, whose products are joins of the matrix' entries with the vector.
Steps then go back down the levels. Tables with a row a variable or factor meet by shuffles, as broadcasts of every round would go through the driver. Damping, acceptance and convergence are kept by graph; graphs of all runs take their rounds together.

Tables: variables (graph, v, value array<double>), factors (graph, kind, vars array<long>, data array<double>); see ``FACTORS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.lineage import cut

#: Numbers of a block on the first level, how many of its blocks make one of the next, and variables that a task eliminates at most.
BLOCK, GROWTH, LIMIT = 96, 16, 900
#: Damping that a graph begins with.
DAMPING = 1e-5
ELEMENT = "graph string, vars array<long>, dims array<int>, h binary, g binary, d binary, lam double"
_STEP = "graph string, block long, vars array<long>, dims array<int>, way binary, base binary, bvars array<long>, bdims array<int>, h binary, g binary, d binary, lam double"
_SOLVED = "graph string, v long, step array<double>"


def wrap(a: np.ndarray) -> np.ndarray:
    return -((-a + math.pi) % (2 * math.pi) - math.pi)


def planar_between(x: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and Jacobians of measured motions; rows of ``x`` are two poses, of ``data`` (dx, dy, dtheta, sigma_turn, sigma_move)."""
    c, s = np.cos(x[:, 2]), np.sin(x[:, 2])
    d = x[:, 3:5] - x[:, :2]
    w = 1 / np.stack([data[:, 4], data[:, 4], data[:, 3]], 1)
    r = np.stack([c * d[:, 0] + s * d[:, 1] - data[:, 0], c * d[:, 1] - s * d[:, 0] - data[:, 1], wrap(x[:, 5] - x[:, 2] - data[:, 2])], 1)
    j = np.zeros((len(x), 3, 6))
    for a, sign in ((0, -1), (3, 1)):
        j[:, 0, a], j[:, 0, a + 1], j[:, 1, a], j[:, 1, a + 1], j[:, 2, a + 2] = sign * c, sign * s, -sign * s, sign * c, sign
    j[:, 0, 2], j[:, 1, 2] = c * d[:, 1] - s * d[:, 0], -c * d[:, 0] - s * d[:, 1]
    return r * w, j * w[:, :, None]


def planar_prior(x: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data``: (x, y, theta, sigma_turn, sigma_move)."""
    w = 1 / np.stack([data[:, 4], data[:, 4], data[:, 3]], 1)
    r = x - data[:, :3]
    r[:, 2] = wrap(r[:, 2])
    return r * w, np.eye(3) * w[:, :, None]


def vector_prior(x: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data``: the value wanted, then a sigma for each component."""
    n = x.shape[1]
    w = 1 / data[:, n:]
    return (x - data[:, :n]) * w, np.eye(n) * w[:, :, None]


def skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    return out - out.transpose(0, 2, 1)


def turn(w: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors."""
    angle = np.linalg.norm(w, axis=1)[:, None, None]
    k = skew(w)
    a, b = np.sinc(angle / math.pi), 0.5 * np.sinc(angle / (2 * math.pi)) ** 2
    return np.eye(3) + a * k + b * (k @ k)


def turned_by(r: np.ndarray) -> np.ndarray:
    """Rotation vectors of rotation matrices, over quaternions, so that half turns come out."""
    m = np.stack([1 + r[:, 0, 0] - r[:, 1, 1] - r[:, 2, 2], 1 - r[:, 0, 0] + r[:, 1, 1] - r[:, 2, 2], 1 - r[:, 0, 0] - r[:, 1, 1] + r[:, 2, 2], 1 + r[:, 0, 0] + r[:, 1, 1] + r[:, 2, 2]], 1)
    q = np.zeros((len(r), 4))
    best = m.argmax(1)
    for k in range(4):
        at = best == k
        if not at.any():
            continue
        o, top = r[at], np.sqrt(m[at, k])
        sums = {(a, b): o[:, a, b] + o[:, b, a] for a in range(3) for b in range(a)}
        diff = [o[:, 2, 1] - o[:, 1, 2], o[:, 0, 2] - o[:, 2, 0], o[:, 1, 0] - o[:, 0, 1]]
        for c in range(4):
            other = top * top if c == k else diff[min(c, k)] if 3 in (c, k) else sums[max(c, k), min(c, k)]
            q[at, c] = other / (2 * top)
    q *= np.where(q[:, 3:] < 0, -1, 1)
    size = np.linalg.norm(q[:, :3], axis=1)
    angle = 2 * np.arctan2(size, q[:, 3])
    return q[:, :3] * np.where(size > 1e-12, angle / np.maximum(size, 1e-300), 2.0)[:, None]


def spatial_between(x: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Motions in space. Poses are (rotation vector, position), ``data`` is such a pose and six sigmas, turns first."""
    return differenced(_spatial_between, x, data)


def _spatial_between(x: np.ndarray, data: np.ndarray) -> np.ndarray:
    a, b, z = turn(x[:, :3]), turn(x[:, 6:9]), turn(data[:, :3])
    at = a.transpose(0, 2, 1)
    zt = z.transpose(0, 2, 1)
    moved = (at @ (x[:, 9:12] - x[:, 3:6])[:, :, None])[:, :, 0] - data[:, 3:6]
    return np.concatenate([turned_by(zt @ at @ b), (zt @ moved[:, :, None])[:, :, 0]], 1) / data[:, 6:]


def spatial_prior(x: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data``: (rotation vector, position) and six sigmas."""

    def residual(x, data):
        zt = turn(data[:, :3]).transpose(0, 2, 1)
        return np.concatenate([turned_by(zt @ turn(x[:, :3])), (zt @ (x[:, 3:6] - data[:, 3:6])[:, :, None])[:, :, 0]], 1) / data[:, 6:]

    return differenced(residual, x, data)


GRAVITY = np.array([0.0, 0.0, -9.80665])


def inertial(x: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Preintegrated motion between (pose, velocity) and (pose, velocity), under a bias (accelerometer, gyro).

    ``data``: seconds, rotation vector, velocity and position change in the first pose's frame without bias, three
    sigmas (turn, velocity, position). A bias acts to first order: turns lose gyro bias x time, velocities and positions the
    accelerometer's share.
    """

    def residual(x, data):
        dt = data[:, :1]
        ri, pi, vi, rj, pj, vj = turn(x[:, :3]), x[:, 3:6], x[:, 6:9], turn(x[:, 9:12]), x[:, 12:15], x[:, 15:18]
        ba, bg = x[:, 18:21], x[:, 21:24]
        it = ri.transpose(0, 2, 1)
        apply = lambda m, v: (m @ v[:, :, None])[:, :, 0]
        dr = turn(data[:, 1:4]) @ turn(-bg * dt)
        turned = turned_by(dr.transpose(0, 2, 1) @ it @ rj)
        speed = apply(it, vj - vi - GRAVITY * dt) - (data[:, 4:7] - ba * dt)
        place = apply(it, pj - pi - vi * dt - GRAVITY * dt * dt / 2) - (data[:, 7:10] - ba * dt * dt / 2)
        sigma = np.repeat(data[:, 10:13], 3, axis=1)
        return np.concatenate([turned, speed, place], 1) / sigma

    return differenced(residual, x, data)


def differenced(residual, x: np.ndarray, data: np.ndarray, h: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Residuals with their Jacobians by central differences over all rows at once."""
    r = residual(x, data)
    j = np.zeros((*r.shape, x.shape[1]))
    for k in range(x.shape[1]):
        step = np.zeros(x.shape[1])
        step[k] = h
        j[:, :, k] = (residual(x + step, data) - residual(x - step, data)) / (2 * h)
    return r, j


#: kind -> (sizes of the variables, residuals and Jacobians).
FACTORS = {
    "planar between": ((3, 3), planar_between),
    "planar prior": ((3,), planar_prior),
    "between": ((6, 6), spatial_between),
    "prior": ((6,), spatial_prior),
    "velocity prior": ((3,), vector_prior),
    "bias prior": ((6,), vector_prior),
    "inertial": ((6, 3, 6, 3, 6), inertial),
}


def _linear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: factors with their values (graph, kind, vars, data, values, lam) -> elements and errors."""
    for batch in batches:
        kinds = np.array(batch.column("kind").to_pylist(), object)
        for kind in dict.fromkeys(kinds.tolist()):
            some = batch.take(pa.array(np.flatnonzero(kinds == kind)))
            dims, of = FACTORS[kind]
            x, data = np.array(some.column("values").to_pylist(), float).reshape(some.num_rows, -1), np.array(some.column("data").to_pylist(), float)
            r, j = of(x, data)
            h = j.transpose(0, 2, 1) @ j
            g = (j.transpose(0, 2, 1) @ r[:, :, None])[:, :, 0]
            d = np.diagonal(h, axis1=1, axis2=2)
            raw = lambda a: pa.array([np.ascontiguousarray(v).tobytes() for v in a], pa.binary())
            columns = [some.column("graph"), some.column("vars"), pa.array([list(dims)] * len(x), pa.list_(pa.int32())), raw(h), raw(g), raw(d), some.column("lam"), pa.array((r**2).sum(1) / 2)]
            yield pa.RecordBatch.from_arrays(columns, ["graph", "vars", "dims", "h", "g", "d", "lam", "error"])


def linearised(factors: DataFrame, variables: DataFrame, state: DataFrame) -> DataFrame:
    """Elements of ``factors`` at the values of ``variables``, with their errors; of graphs that ``state`` (graph, lam) names."""
    sides = factors.withColumn("f", F.monotonically_increasing_id()) if "f" not in factors.columns else factors
    met = sides.select("graph", "f", F.posexplode("vars").alias("at", "v")).join(variables.select("graph", "v", "value").hint("merge"), ["graph", "v"])
    values = met.groupBy("graph", "f").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("all"))
    whole = sides.join(values.hint("merge"), ["graph", "f"]).where(F.size("all") == F.size("vars")).join(state.select("graph", "lam"), "graph")
    rows = whole.select("graph", "kind", "vars", "data", F.flatten(F.transform("all", lambda a: a["value"])).alias("values"), "lam")
    return rows.mapInArrow(_linear, ELEMENT + ", error double")


def _offsets(dims: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(dims)]).astype(np.int64)


def _assembled(rows: list[dict], order: dict[int, int], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of elements over the variables of ``order``, whose components begin at ``starts``."""
    n = int(starts[-1])
    h, g, d = np.zeros((n, n)), np.zeros(n), np.zeros(n)
    for row in rows:
        at = np.concatenate([np.arange(starts[order[v]], starts[order[v] + 1]) for v in row["vars"]])
        h[np.ix_(at, at)] += np.frombuffer(row["h"]).reshape(len(at), -1)
        g[at] += np.frombuffer(row["g"])
        d[at] += np.frombuffer(row["d"])
    return h, g, d


def _eliminate(key: tuple, inner: pa.Table, shared: pa.Table) -> pa.Table:
    """Group function of a block: eliminates the variables that its elements alone touch."""
    rows, outer = inner.to_pylist(), set(shared.column("v").to_pylist())
    dims = {v: n for row in rows for v, n in zip(row["vars"], row["dims"], strict=True)}
    own, rest = sorted(v for v in dims if v not in outer), sorted(v for v in dims if v in outer)
    if not rows:
        return pa.Table.from_pylist([], schema=_schema())
    order = {v: k for k, v in enumerate([*own, *rest])}
    starts = _offsets([dims[v] for v in order])
    h, g, d = _assembled(rows, order, starts)
    n, lam = int(starts[len(own)]), rows[0]["lam"]
    hi = h[:n, :n] + np.diag(lam * np.maximum(d[:n], 1e-12))
    solved = np.linalg.solve(hi, np.concatenate([g[:n, None], h[:n, n:]], 1)) if n else np.zeros((0, 1 + len(h) - n))
    base, way = -solved[:, 0], solved[:, 1:]
    s, gs = h[n:, n:] - h[n:, :n] @ way, g[n:] + h[n:, :n] @ base
    out = {"graph": key[0].as_py(), "block": key[1].as_py(), "vars": own, "dims": [dims[v] for v in own], "way": way.tobytes(), "base": base.tobytes(), "bvars": rest, "bdims": [dims[v] for v in rest]}
    out |= {"h": ((s + s.T) / 2).tobytes(), "g": gs.tobytes(), "d": d[n:].tobytes(), "lam": lam}
    return pa.Table.from_pylist([out], schema=_schema())


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in _STEP.split(", "))])


def _own(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that it may meet a table that it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _level(elements: DataFrame, width: int) -> DataFrame:
    """One row a block of ``width`` numbers: what was eliminated, and the element over what is left."""
    blocks = elements.withColumn("blocks", F.array_distinct(F.transform("vars", lambda v: F.floor(v / width))))
    inner = blocks.where(F.size("blocks") == 1).withColumn("block", F.element_at("blocks", 1)).drop("blocks")
    shared = blocks.where(F.size("blocks") > 1).select("graph", F.explode("vars").alias("v")).distinct().withColumn("block", F.floor(F.col("v") / width))
    return inner.groupBy("graph", "block").cogroup(_own(shared).groupBy("graph", "block")).applyInArrow(_eliminate, _STEP)


def _back(key: tuple, steps: pa.Table, known: pa.Table) -> pa.Table:
    """Group function of a block: steps of its eliminated variables from those of the others."""
    at = dict(zip(known.column("v").to_pylist(), known.column("step").to_pylist(), strict=True))
    graphs, names, found = [], [], []
    for row in steps.to_pylist():
        x = np.array([c for v in row["bvars"] for c in at[v]], float)
        base = np.frombuffer(row["base"])
        if not len(base):
            continue  # nothing of the block could be eliminated
        step = base - np.frombuffer(row["way"]).reshape(len(base), -1) @ x if len(x) else base
        starts = _offsets(row["dims"])
        graphs += [row["graph"]] * len(row["vars"])
        names += row["vars"]
        found += [step[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]
    return pa.table({"graph": pa.array(graphs, pa.string()), "v": pa.array(names, pa.int64()), "step": pa.array(found, pa.list_(pa.float64()))})


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: elements -> (graph, v, c, w, k, value, grad, damp): entries of the matrix; the gradient goes with those of the diagonal."""
    for batch in batches:
        for row in batch.to_pylist():
            names = [(v, c) for v, n in zip(row["vars"], row["dims"], strict=True) for c in range(n)]
            h, g, d = np.frombuffer(row["h"]).reshape(len(names), -1), np.frombuffer(row["g"]), np.frombuffer(row["d"])
            n = len(names)
            v, c = (np.array(x, np.int64) for x in zip(*names, strict=True))
            r, k = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
            same = r == k
            columns = [pa.array([row["graph"]] * (n * n)), *[pa.array(x) for x in (v[r], c[r], v[k], c[k], h.ravel(), np.where(same, g[r], 0.0), np.where(same, row["lam"] * d[r], 0.0))]]
            yield pa.RecordBatch.from_arrays(columns, ["graph", "v", "c", "w", "k", "value", "grad", "damp"])


def conjugate(elements: DataFrame, rounds: int = 2000, accuracy: float = 1e-7) -> DataFrame:
    """(graph, v, step): the equations of ``elements`` solved by conjugate gradients, preconditioned by the diagonal.

    A round joins the matrix' entries with the direction once and sums by row. A graph is done when its residual has shrunk to
    ``accuracy``; its step counts as it is if ``rounds`` come first, and is judged by the error it leads to.
    """
    kind = "graph string, v long, c long, w long, k long, value double, grad double, damp double"
    entries = elements.select("graph", "vars", "dims", "h", "g", "d", "lam").mapInArrow(_entries, kind)
    diagonal = (F.col("v") == F.col("w")) & (F.col("c") == F.col("k"))
    matrix = cut(entries.groupBy("graph", "v", "c", "w", "k").agg((F.sum("value") + F.when(diagonal, F.sum("damp")).otherwise(0.0)).alias("value"), F.sum("grad").alias("grad")))
    rows = matrix.where(diagonal).select("graph", "v", "c", F.lit(0.0).alias("x"), (-F.col("grad")).alias("r"), F.col("value").alias("m"))
    rows = rows.withColumn("p", F.col("r") / F.col("m"))
    rows = cut(rows.withColumn("rz", F.sum(F.col("r") * F.col("p")).over(Window.partitionBy("graph"))).withColumns({"goal": F.col("rz") * accuracy**2}))
    for _ in range(rounds):
        going = rows.where(F.col("rz") > F.col("goal"))
        if going.isEmpty():
            break
        along = going.select("graph", F.col("v").alias("w"), F.col("c").alias("k"), "p")
        product = matrix.join(along.hint("merge"), ["graph", "w", "k"]).groupBy("graph", "v", "c").agg(F.sum(F.col("value") * F.col("p")).alias("q"))
        met = rows.join(product.hint("merge"), ["graph", "v", "c"], "left")
        sums = met.groupBy("graph").agg(F.sum(F.col("p") * F.col("q")).alias("pq"))
        met = met.join(sums, "graph").withColumn("alpha", F.when(F.col("pq") > 0, F.col("rz") / F.col("pq")).otherwise(0.0))
        met = met.withColumns({"x": F.col("x") + F.col("alpha") * F.col("p"), "r": F.col("r") - F.col("alpha") * F.coalesce("q", F.lit(0.0))})
        met = met.withColumn("z", F.col("r") / F.col("m"))
        size = met.groupBy("graph").agg(F.sum(F.col("r") * F.col("z")).alias("new"))
        met = met.join(size, "graph").withColumns({"p": F.col("z") + F.when(F.col("rz") > 0, F.col("new") / F.col("rz")).otherwise(0.0) * F.col("p"), "rz": F.when(F.col("alpha") > 0, F.col("new")).otherwise(0.0)})
        rows = cut(met.select("graph", "v", "c", "x", "r", "m", "p", "rz", "goal"))
    return rows.groupBy("graph", "v").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("step"))


def steps(elements: DataFrame, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """(graph, v, step): the solution of the damped equations of ``elements``, which are read several times."""
    width, levels, solved, most = block, [], None, 0  # a first block has no more variables than numbers
    while most is not None and most <= limit:
        level = cut(_level(elements, width))
        levels.append(level)
        left = level.where(F.size("bvars") > 0).select("graph", F.col("bvars").alias("vars"), F.col("bdims").alias("dims"), "h", "g", "d", "lam")
        crossing = elements.where(F.size(F.array_distinct(F.transform("vars", lambda v: F.floor(v / width)))) > 1)  # noqa: B023
        elements, width = left.unionByName(crossing.select(left.columns)), width * GROWTH
        touched = elements.select("graph", F.explode("vars").alias("v")).distinct().groupBy("graph", F.floor(F.col("v") / width)).count()
        most = touched.agg(F.max("count")).first()[0]
    if most is not None:
        solved = cut(conjugate(cut(elements)))
    for level in reversed(levels):
        if solved is None:
            known = level.select("graph", "block", F.lit(None).cast("long").alias("v"), F.lit(None).cast("array<double>").alias("step")).limit(0)
        else:
            known = level.select("graph", "block", F.explode("bvars").alias("v")).join(solved.hint("merge"), ["graph", "v"])
        new = level.groupBy("graph", "block").cogroup(_own(known).groupBy("graph", "block")).applyInArrow(_back, _SOLVED)
        solved = new if solved is None else _own(solved).unionByName(new)
    return solved


@dataclass(frozen=True)
class Report:
    """What :func:`optimised` gives: the variables, and by graph its initial and final error and rounds."""

    variables: DataFrame
    graphs: DataFrame


def _moved(variables: DataFrame, step: DataFrame) -> DataFrame:
    """Values after a step; angles are wrapped and rotation vectors brought back within half a turn."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, value, s in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), batch.column("step").to_pylist(), strict=True):
                x = np.array(value, float) + (np.array(s, float) if s else 0.0)
                if kind == "planar":
                    x[2] = wrap(x[2])
                elif kind == "pose":
                    x[:3] = turned_by(turn(x[None, :3]))[0]
                out.append(x.tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("graph", "v", "kind")), pa.array(out, pa.list_(pa.float64()))], ["graph", "v", "kind", "value"])

    met = variables.join(step.hint("merge"), ["graph", "v"], "left")
    return met.select("graph", "v", "kind", "value", "step").mapInArrow(moved, "graph string, v long, kind string, value array<double>")


def optimised(variables: DataFrame, factors: DataFrame, most: int = 50, block: int = BLOCK, limit: int = LIMIT) -> Report:
    """Levenberg-Marquardt over all graphs of ``variables`` (graph, v, kind, value) and ``factors`` (graph, kind, vars, data) at once.

    Kinds of variables: planar (x, y, theta), pose (rotation vector, position), velocity, bias. Factors that name a variable
    which isn't there don't count. A graph ends when its error changes by less than 1e-10 of itself (or of 1e-6), when no damping helps,
    or after ``most`` rounds; graphs without factors stay as they are.
    """
    graph = F.col("graph").cast("string")
    now = cut(variables.select(graph.alias("graph"), F.col("v").cast("long").alias("v"), "kind", F.col("value").cast("array<double>").alias("value")))
    factors = cut(factors.select(graph.alias("graph"), "kind", F.col("vars").cast("array<long>").alias("vars"), F.col("data").cast("array<double>").alias("data")).withColumn("f", F.monotonically_increasing_id()))
    start = factors.select("graph").distinct().withColumn("lam", F.lit(DAMPING))
    elements = cut(linearised(factors, now, start))
    state = cut(elements.groupBy("graph").agg(F.sum("error").alias("error")).withColumns({"initial": F.col("error"), "lam": F.lit(DAMPING), "rounds": F.lit(0), "done": F.lit(False)}))
    for _ in range(most):
        going = state.where("not done")
        if going.isEmpty():
            break
        lam = going.select("graph", F.col("lam").alias("__lam"))
        step = steps(elements.join(lam, "graph").withColumn("lam", F.col("__lam")).drop("__lam", "error"), block, limit)
        trial = cut(_moved(now, step))
        new = cut(linearised(factors, trial, going))
        error = new.groupBy("graph").agg(F.sum("error").alias("trial"))
        met = state.join(error, "graph", "left")
        better = F.col("trial").isNotNull() & ~F.isnan("trial") & (F.col("trial") <= F.col("error"))
        small = F.abs(F.col("error") - F.col("trial")) <= 1e-10 * F.greatest(F.col("error"), F.lit(1e-6))
        lam = F.when(better, F.greatest(F.col("lam") / 10, F.lit(1e-12))).otherwise(F.col("lam") * 10)
        ended = F.col("done") | F.coalesce(small, F.lit(False)) | (~better & (F.col("lam") * 10 > 1e12))
        active = ~F.col("done")
        out = {"better": active & better, "ended": ended, "new_lam": F.when(active, lam).otherwise(F.col("lam")), "new_error": F.when(active & better, F.col("trial")).otherwise(F.col("error")), "n": F.col("rounds") + active.cast("int")}
        state = cut(met.withColumns(out).select("graph", F.col("new_error").alias("error"), "initial", F.col("new_lam").alias("lam"), F.col("n").alias("rounds"), F.col("ended").alias("done"), "better"))
        if state.where("not better").isEmpty():
            now, elements = trial, new
            continue
        taken = state.where("better").select("graph")
        kept = lambda old, fresh: fresh.join(taken, "graph", "left_semi").unionByName(old.join(taken, "graph", "left_anti"))  # noqa: E731, B023
        now, elements = cut(kept(now, trial)), cut(kept(elements, new))
    return Report(now, state.select("graph", F.col("initial").alias("initial_error"), F.col("error").alias("final_error"), "rounds"))


def planar(anchors: DataFrame, edges: DataFrame, key: str, prior: float = 1e-4, **kw) -> Report:
    """:func:`optimised` for planar anchors (key, node, x, y, theta) and edges (key, from, to, dx, dy, dtheta, sigma_turn, sigma_move).

    The first node of each graph is held where it is by a prior. Edges from a node to itself do not count.
    """
    value = F.array(*[F.col(c).cast("double") for c in ("x", "y", "theta")])
    graph = F.col(key).cast("string").alias("graph")
    variables = anchors.select(graph, F.col("node").cast("long").alias("v"), F.lit("planar").alias("kind"), value.alias("value"))
    measured = F.array(*[F.col(c).cast("double") for c in ("dx", "dy", "dtheta", "sigma_turn", "sigma_move")])
    between = edges.where(F.col("from") != F.col("to")).select(graph, F.lit("planar between").alias("kind"), F.array(F.col("from").cast("long"), F.col("to").cast("long")).alias("vars"), measured.alias("data"))
    first = variables.groupBy("graph").agg(F.min_by("value", "v").alias("value"), F.min("v").alias("v")).join(between.select("graph").distinct(), "graph", "left_semi")
    held = first.select("graph", F.lit("planar prior").alias("kind"), F.array("v").alias("vars"), F.concat("value", F.array(F.lit(prior), F.lit(prior))).alias("data"))
    return optimised(variables, between.unionByName(held), **kw)
