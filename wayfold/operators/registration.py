"""Scan registration and pose graphs: small dense solvers that run inside ordered folds or grouped tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def se2_apply(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    c, s = math.cos(t[2]), math.sin(t[2])
    return p @ np.array([[c, s], [-s, c]]) + t[:2]


def se2_compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    xy = se2_apply(a, b[None, :2])[0]
    return np.array([xy[0], xy[1], wrap(a[2] + b[2])])


def se2_inverse(a: np.ndarray) -> np.ndarray:
    c, s = math.cos(a[2]), math.sin(a[2])
    return np.array([-c * a[0] - s * a[1], s * a[0] - c * a[1], wrap(-a[2])])


def wrap(a: float) -> float:
    return -((-a + math.pi) % (2 * math.pi) - math.pi)


@dataclass(frozen=True)
class Matching:
    """Defaults of the matcher."""

    iterations: int = 30
    gate: float = 1.0
    trim: float = 0.2
    least: int = 20
    eps_move: float = 1e-6
    eps_turn: float = 1e-7
    weak: float = 0.02


@dataclass
class Match:
    pose: np.ndarray
    residual: float
    inliers: float
    weak: np.ndarray | None


#: Pairs of queries and references up to which all distances are taken: a scan's are fewer than what a grid costs to walk.
DENSE = 1 << 18


class Neighbours:
    """Two nearest references within a gate, of all of them or, of many, from a grid of cells as wide as the gate; ties go to the lower index."""

    def __init__(self, points: np.ndarray, gate: float):
        self.points, self.gate, self.held = points, gate, None
        cells = np.floor(points / gate).astype(np.int64)
        self.low, self.span = cells.min(0) - 1, cells.max(0) - cells.min(0) + 3
        key = self._key(cells)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def _key(self, cells: np.ndarray) -> np.ndarray:
        at = cells - self.low
        inside = ((at >= 0) & (at < self.span)).all(1)
        return np.where(inside, at[:, 0] * self.span[1] + at[:, 1], -1)

    def two(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices, squared distances), two columns each; -1 and infinity where there is none."""
        if 0 < len(queries) * len(self.points) <= DENSE:
            return self._dense(queries)
        cells = np.floor(queries / self.gate).astype(np.int64)
        who, refs = [], []
        for step in [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
            key = self._key(cells + np.array(step))
            a, b = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            n = np.where(key >= 0, b - a, 0)
            who.append(np.repeat(np.arange(len(queries)), n))
            refs.append(self.order[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        who, refs = np.concatenate(who), np.concatenate(refs)
        d2 = ((queries[who] - self.points[refs]) ** 2).sum(1)
        near = d2 <= self.gate**2
        who, refs, d2 = who[near], refs[near], d2[near]
        order = np.lexsort((refs, d2, who))
        who, refs, d2 = who[order], refs[order], d2[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
        index, dist = np.full((len(queries), 2), -1), np.full((len(queries), 2), np.inf)
        top = rank < 2
        index[who[top], rank[top]], dist[who[top], rank[top]] = refs[top], d2[top]
        return index, dist

    def _dense(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(queries), len(self.points)
        if self.held is None or self.held[0].shape != shape:
            self.held = np.empty(shape), np.empty(shape)  # kept, as a scan asks several times
        d2, dy2 = self.held
        for k, out in enumerate(self.held):
            np.subtract(queries[:, k, None], self.points[:, k], out=out)
            np.multiply(out, out, out=out)
        d2 += dy2
        index, dist, rows = np.empty((len(queries), 2), int), np.empty((len(queries), 2)), np.arange(len(queries))
        for k in (0, 1):
            best = d2.argmin(1)
            far = d2[rows, best]
            near = far <= self.gate**2
            index[:, k], dist[:, k] = np.where(near, best, -1), np.where(near, far, np.inf)
            d2[rows, best] = np.inf
        return index, dist


def weak_axis(h00: float, h01: float, h11: float, ratio: float) -> np.ndarray | None:
    """Unit vector of the direction that the sums hardly constrain, if there is one."""
    values, vectors = np.linalg.eigh(np.array([[h00, h01], [h01, h11]]))
    return vectors[:, 0] if values[0] <= ratio * values[1] else None


def match(current: np.ndarray, reference: Neighbours, start: np.ndarray, cfg: Matching = Matching()) -> Match | None:
    """Trimmed point-to-line registration of ``current`` against a reference; None if either has too few points, or too few pairs, or singular.

    A point whose only reference, or whose references in one place, it lies on itself tells no direction and is left out.
    """
    if min(len(current), len(reference.points)) < cfg.least:
        return None
    pose = np.array(start, float)
    out = None
    for _ in range(cfg.iterations):
        moved = se2_apply(pose, current)
        index, _ = reference.two(moved)
        used = np.flatnonzero(index[:, 0] >= 0)
        q, a = moved[used], reference.points[index[used, 0]]
        line = reference.points[np.maximum(index[used, 1], 0)] - a
        size = np.hypot(line[:, 0], line[:, 1])
        normal = np.stack([-line[:, 1], line[:, 0]], 1) / np.maximum(size, 1e-300)[:, None]
        gap = q - a
        far = np.hypot(gap[:, 0], gap[:, 1])
        lone = (index[used, 1] < 0) | (size < 1e-9)
        normal[lone] = gap[lone] / np.maximum(far[lone, None], 1e-12)
        told = ~lone | (far >= 1e-12)
        q, gap, normal = q[told], gap[told], normal[told]
        residual = (normal * gap).sum(1)
        keep = int(math.floor(len(q) * (1 - cfg.trim)))
        if keep < cfg.least:
            return None
        best = np.argsort(np.abs(residual), kind="stable")[:keep]
        n, p, r = normal[best], q[best], residual[best]
        j = np.stack([n[:, 0], n[:, 1], n[:, 1] * p[:, 0] - n[:, 0] * p[:, 1]], 1)
        h = j.T @ j
        try:
            np.linalg.cholesky(h)
        except np.linalg.LinAlgError:
            return None
        step = -np.linalg.solve(h, j.T @ r)
        pose = se2_compose(step, pose)
        out = Match(pose, float(np.abs(r).mean()), keep / len(current), weak_axis(h[0, 0], h[0, 1], h[1, 1], cfg.weak))
        if np.hypot(step[0], step[1]) < cfg.eps_move and abs(step[2]) < cfg.eps_turn:
            break
    return out


def points_of(row) -> np.ndarray:
    """Usable beams of a scan row as points."""
    r = np.asarray(row["ranges"], float)
    with np.errstate(invalid="ignore"):
        fine = np.isfinite(r) & (r >= row["range_min"]) & (r <= row["range_max"])
    angle = row["angle_min"] + np.flatnonzero(fine) * row["angle_increment"]
    return np.stack([r[fine] * np.cos(angle), r[fine] * np.sin(angle)], 1)


class ScanOdometry:
    """Planar odometry: each scan is matched to the last keyframe, or coasts on constant velocity where that fails."""

    columns = "stamp_ns long, x double, y double, theta double, outcome string, inliers double"

    def __init__(self, least_points: int = 50, least_inliers: float = 0.4, move: float = 0.3, turn: float = 0.3, cfg: Matching = Matching()):
        self.least_points, self.least_inliers, self.move, self.turn, self.cfg = least_points, least_inliers, move, turn, cfg
        self.pose, self.motion, self.keyframe, self.frame = np.zeros(3), np.zeros(3), None, None

    def step(self, row) -> dict:
        points = points_of(row)
        if len(points) < self.least_points:
            return self._row(row, "skipped", 0.0)
        outcome, inliers = "keyframe", 1.0
        if self.frame is not None:
            guess = se2_compose(self.pose, self.motion)
            relative = se2_compose(se2_inverse(self.keyframe), guess)
            found = match(points, self.frame, relative, self.cfg)
            outcome, inliers = "coasted", 0.0
            if found is not None and found.inliers >= self.least_inliers:
                pose = found.pose
                if found.weak is not None:  # what the scan can't tell is taken from the prediction
                    pose[:2] += found.weak * (found.weak @ (relative[:2] - pose[:2]))
                guess, outcome, inliers = se2_compose(self.keyframe, pose), "matched", found.inliers
            before, self.pose = self.pose, guess
            self.motion = se2_compose(se2_inverse(before), self.pose)
        moved = np.zeros(3) if self.keyframe is None else se2_compose(se2_inverse(self.keyframe), self.pose)
        if self.frame is None or outcome == "coasted" or math.hypot(moved[0], moved[1]) > self.move or abs(moved[2]) > self.turn:
            self.keyframe, self.frame = self.pose.copy(), Neighbours(points, self.cfg.gate)
        return self._row(row, outcome, inliers)

    def _row(self, row, outcome: str, inliers: float) -> dict:
        return {"stamp_ns": row["stamp_ns"], "x": self.pose[0], "y": self.pose[1], "theta": self.pose[2], "outcome": outcome, "inliers": inliers}


def optimise(poses: np.ndarray, edges: list[tuple[int, int, np.ndarray, float, float]], prior: float = 1e-4, most: int = 50) -> np.ndarray | None:
    """Levenberg-Marquardt over planar poses; edges are (from, to, relative pose, sigma of turn, sigma of move).

    The first pose is held by a prior. Edges with ends out of range or equal do not count. None without at least two
    poses and one edge, or where no step lowers the error.
    """
    edges = [e for e in edges if e[0] != e[1] and 0 <= min(e[:2]) and max(e[:2]) < len(poses)]
    if len(poses) < 2 or not edges:
        return None
    x, start, damping = poses.astype(float).copy(), poses[0].astype(float), 1e-4

    def linear(x):
        rows, h, g = 0.0, np.zeros((3 * len(x), 3 * len(x))), np.zeros(3 * len(x))
        r = np.array([*(x[0, :2] - start[:2]), wrap(x[0, 2] - start[2])]) / prior
        h[:3, :3] += np.eye(3) / prior**2
        g[:3] += r / prior
        rows += r @ r
        for i, j, z, st, sm in edges:
            c, s = math.cos(x[i, 2]), math.sin(x[i, 2])
            rt = np.array([[c, s], [-s, c]])
            d = x[j, :2] - x[i, :2]
            w = np.array([1 / sm, 1 / sm, 1 / st])
            e = np.array([*(rt @ d - z[:2]), wrap(x[j, 2] - x[i, 2] - z[2])]) * w
            a, b = np.zeros((3, 3)), np.zeros((3, 3))
            a[:2, :2], a[:2, 2], a[2, 2] = -rt, np.array([[-s, c], [-c, -s]]) @ d, -1
            b[:2, :2], b[2, 2] = rt, 1
            for p, jp in ((i, a * w[:, None]), (j, b * w[:, None])):
                g[3 * p : 3 * p + 3] += jp.T @ e
                for q, jq in ((i, a * w[:, None]), (j, b * w[:, None])):
                    h[3 * p : 3 * p + 3, 3 * q : 3 * q + 3] += jp.T @ jq
            rows += e @ e
        return rows, h, g

    error, h, g = linear(x)
    for _ in range(most):
        step = np.linalg.solve(h + damping * np.diag(np.diag(h)), -g).reshape(-1, 3)
        new = x + step
        new[:, 2] = [wrap(a) for a in new[:, 2]]
        trial, h2, g2 = linear(new)
        if not math.isfinite(trial) or trial > error:
            damping *= 10
            if damping > 1e12:
                break
            continue
        done = error - trial <= 1e-12 * max(1.0, error)
        x, error, h, g, damping = new, trial, h2, g2, max(damping / 10, 1e-12)
        if done:
            break
    return x if np.isfinite(x).all() else None


def optimised(anchors: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, node, x, y, theta): one pose graph per key. Anchors are (key, node from 0, x, y, theta), edges (key, from, to, dx, dy, dtheta, sigma_turn, sigma_move).

    A graph is one key's anchors and edges, some hundreds of nodes; graphs are solved apart, where a solve fails the
    anchors stay.
    """

    def solve(k, a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("node")
        links = [(int(r["from"]), int(r["to"]), np.array([r["dx"], r["dy"], r["dtheta"]]), r["sigma_turn"], r["sigma_move"]) for r in e.to_dict("records")]
        old = a[["x", "y", "theta"]].to_numpy(float)
        new = optimise(old, links)
        x = old if new is None else new
        return pd.DataFrame({key: k[0], "node": a["node"].to_numpy(), "x": x[:, 0], "y": x[:, 1], "theta": x[:, 2]})

    kinds = f"`{key}` {anchors.schema[key].dataType.simpleString()}, node int, x double, y double, theta double"
    links = edges.select(*[F.col(c).alias(c) for c in edges.columns])  # columns of its own, should both come from one table
    return anchors.groupBy(key).cogroup(links.groupBy(key)).applyInPandas(solve, kinds)
