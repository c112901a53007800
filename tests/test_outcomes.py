"""Runs of a folder scored together, against plain loops; runs that lack or break something."""

import json

import numpy as np
import pytest

from wayfold.plans import outcomes
from wayfold.sources.text import POSE

LOG = """something before
health: 41 matched / 3 coasted / 2 skipped /
    5 degenerate; 6 submap hand-overs, 1 verified loop closures
\tMaximum resident set size (kbytes): 204800
health: 1 matched / 1 coasted / 1 skipped / 1 degenerate; 1 submap hand-overs, 1 verified loop
"""


def turned(q, v, back=False):
    w, u = q[3], -q[:3] if back else q[:3]
    return v + 2 * np.cross(u, np.cross(u, v) + w * v)


def figures(est, ref):
    """(aligned error, relative error) of rows (tx ... qw) that are already associated."""
    p, q = est[:, :3], ref[:, :3]
    u, _, vt = np.linalg.svd((q - q.mean(0)).T @ (p - p.mean(0)))
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    ate = np.sqrt((((p - p.mean(0)) @ r.T + q.mean(0) - q) ** 2).sum(1).mean())
    ends, way = [0], 0.0
    for k in range(1, len(p)):
        way += np.linalg.norm(p[k] - p[k - 1])
        if way >= 1.0:
            ends.append(k)
            way = 0.0
    d = [turned(est[a, 3:], p[b] - p[a], True) - turned(ref[a, 3:], q[b] - q[a], True) for a, b in zip(ends, ends[1:])]
    return ate, np.sqrt((np.array(d) ** 2).sum(1).mean())


@pytest.fixture
def runs(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 80
    stamps = 1_700_000_000_000_000_000 + np.arange(n) * 100_000_000
    unit = lambda q: q / np.linalg.norm(q, axis=1, keepdims=True)
    ref = np.column_stack([np.cumsum(rng.normal(0.1, 0.1, (n, 3)), 0), unit(rng.normal(0, 1, (n, 4)))])
    est = np.column_stack([ref[:, [1, 0, 2]] * [1, -1, 1] + rng.normal(0, 0.02, (n, 3)) + 5, unit(ref[:, 3:] + rng.normal(0, 0.05, (n, 4)))])
    lines = lambda rows, late=3_000_000: "# t tx\n" + "\n".join(f"{(s + late) // 10**9}.{(s + late) % 10**9:09d} " + " ".join(map(repr, map(float, r))) for s, r in zip(stamps.tolist(), rows)) + "\n"
    put = lambda name, body: (tmp_path / name).write_text(body)
    put("hall.one.fast.tum", lines(est))
    put("hall.one.fast.metrics.json", json.dumps({"real_time_factor": 7.5, "latency_us": {"p50": 1, "p99": 321.0}, "n_samples": 1234, "more": [1]}, indent=1))
    put("hall.one.fast.log", LOG)
    put("hall.one.slow.tum", lines(est[::-1]))
    put("hall.one.slow.metrics.json", '{"real_time_factor": 2.0, "latency_us": null}')
    put("hall.one.slow.log", "killed")
    put("hall.one.bad.tum", lines(est) + "1.5 2 3\n")
    put("hall.one.bad.metrics.json", "{not json")
    put("hall.one.empty.tum", "# nothing\n")
    put("hall.one.late.tum", lines(est, 40_000_000))
    put("other.fast.tum", lines(est))
    put("hall.one.alone.log", LOG)
    truth = spark.createDataFrame([("hall.one", int(s), *map(float, r)) for s, r in zip(stamps, ref, strict=True)] + [("hall.one", int(stamps[0]), *([9e9] * 7))], "sequence string, stamp_ns long, " + ", ".join(f"{c} double" for c in POSE))
    return str(tmp_path), truth, est, ref


def test_runs_against_plain_loops(spark, runs):
    folder, truth, est, ref = runs
    found = {r.tag: r for r in outcomes.scored(spark, folder, truth).collect()}
    assert set(found) == {"hall.one.fast", "hall.one.slow", "hall.one.bad", "hall.one.empty", "hall.one.late", "other.fast"}
    fast, slow = found["hall.one.fast"], found["hall.one.slow"]
    assert (fast.sequence, fast.config, fast.error) == ("hall.one", "fast", None)
    assert (fast.ate, fast.rpe) == pytest.approx(figures(est, ref), rel=1e-6)
    assert (slow.ate, slow.rpe) == pytest.approx(figures(est[::-1], ref), rel=1e-6)
    assert (fast.rtf, fast.p99_us, fast.events, fast.rss_mb) == (7.5, 321.0, 1234, 200.0)
    assert (fast.matched, fast.coasted, fast.degenerate, fast.submaps, fast.loops) == (41, 3, 5, 7, 1)
    assert (slow.rtf, slow.p99_us, slow.events, slow.rss_mb, slow.matched, slow.submaps) == (2.0, None, None, None, None, None)
    errors = {t: r.error for t, r in found.items() if r.error}
    none = "no ground truth within 10 ms"
    assert errors == {"hall.one.bad": "broken lines", "hall.one.empty": "no poses", "hall.one.late": none, "other.fast": none}
    assert all(found[t].ate is None and found[t].rpe is None for t in errors)
    assert found["hall.one.bad"].rtf is None


def test_an_empty_folder(spark, runs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    assert outcomes.scored(spark, folder, runs[1]).count() == 0
