import hashlib
import random
import re

import numpy as np
import pytest

from wayfold.llm import graph, jaccard, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(rows):
    out = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def components(rows):
    sets = word_sets(rows)
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return {i: (len(sets[i]), least[i]) for i in sets}


def near_copies(seed, n=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = i % 4
        base = passage[:] if kind < 2 else [rng.choice(words) for _ in range(rng.randrange(3, 50))]
        for _ in range(rng.randrange(0, 4) if kind < 2 else 0):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, (" " if kind else "\n").join(base), "en"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_near_copies(docs, seed):
    rows = near_copies(seed) + [(100, None, "en"), (101, "", None), (102, " \n\t ", "en"), (103, "A b", "en"), (104, "a B", "en"), (105, "a b c", "en"), (106, "Ä x y z q r", "en"), (107, "ä x y z q r", "en"), (5, near_copies(seed)[5][1], "en")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows)).collect()}
    assert found == components(rows)


def test_heavy_shingles_and_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    rows = near_copies(9, 60) + [(200 + k, "same words in every one of these texts here", "en") for k in range(40)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows).repartition(3)).collect()}
    assert found == components(rows)


def test_no_rows(docs):
    assert jaccard.jaccard_components(docs([])).count() == 0
    assert suffix_dedup.digests(docs([])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.v: r.c for r in graph.components(edges).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def repeated(rows):
    seen, out = {}, []
    for i, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            seen.setdefault(raw[k : k + 50], i)
    for i, t, _ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if i is not None and seen[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def overlapping(seed):
    rng = random.Random(seed)
    long = "".join(rng.choice("abcdé fghij\n") for _ in range(400))
    rows = []
    for i in range(25):
        a, n = rng.randrange(0, 350), rng.randrange(20, 120)
        own = "".join(rng.choice("klmno pq") for _ in range(rng.randrange(0, 80)))
        rows.append((i, own + long[a : a + n] + own[::-1] + (long[:60] if i % 5 == 0 else ""), "en"))
    rows += [(30, "ab" * 200, "en"), (31, "ab" * 100, "en"), (32, "x" * 300, "en"), (33, "y" + "x" * 49, "en"), (34, None, None), (35, "", "en"), (36, "z" * 50, "en"), (36, "z" * 50, "en"), (37, "z" * 50, "en"), (None, "z" * 60, "en")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes(docs, seed):
    rows = overlapping(seed)
    assert sorted(map(tuple, suffix_dedup.digests(docs(rows)).collect()), key=str) == repeated(rows)


def test_pieces_of_long_texts(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 128)
    rows = overlapping(3)
    own = [np.concatenate([np.stack([s.first + s.shift, s.last + s.shift], 1) for s in suffix_dedup.stretches([t.encode()])]) for _, t, _ in rows if t and len(t.encode()) >= 50]
    for w, t in zip(own, [t for _, t, _ in rows if t and len(t.encode()) >= 50], strict=True):
        covered = sorted(k for a, b in w for k in range(a, b + 1))
        assert covered == list(range(len(t.encode()) - 49))


def test_texts_without_repeats(docs):
    rows = overlapping(4)
    left = {(r.doc_id, r.source, r.bucket): r.text for r in suffix_dedup.without_repeats(docs(rows)).collect()}
    assert left[(34, "s", "x")] is None and left[(37, "s", "x")] == "" and left[(32, "s", "x")] == "x" * 300


def test_multikey_order():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    assert (np.stack(keys, 1)[suffix_dedup.multikey_order(*keys)] == np.stack(keys, 1)[np.lexsort(keys[::-1])]).all()
