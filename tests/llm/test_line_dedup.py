import hashlib
import random
from collections import defaultdict

import numpy as np

from wayfold.llm import line_dedup as ld

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "a line of more than forty characters, number "


def brute(rows, least_docs=5, least_chars=40):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(key(x)) >= least_chars and len(held[key(x)]) >= least_docs and max(held[key(x)]) != i for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, docs, rows):
    df = docs([(i, t, "en") for i, t in rows])
    found = ld.digests(df)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)
    left = ld.without_repeated_lines(df)
    assert left.columns == df.columns
    want = {(i, s) for i, _, _, s in brute(rows)}
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in left.collect()} == want
    assert left.where("text is null").count() == sum(t is None for _, t in rows)


def test_against_brute_force(spark, docs):
    rng = random.Random(3)
    lines = [LONG + str(k) for k in range(40)] + ["short", "", "   ", "é" * 40, "É" * 40, "x" * 39, "y" * 40]
    dressed = lambda x: rng.choice(["", "\t", " \r"]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", "  ", "\x0b"])
    rows = [(i, "\n".join(dressed(rng.choice(lines)) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    check(spark, docs, rows)


def test_cases(spark, docs):
    hot = LONG + "hot"
    rows = [(i, f"{hot}\n{LONG}{i}\n{hot}") for i in range(20)]  # the largest id keeps both lines
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, hot), (None, None), (7, hot), (7, hot), (-3, hot)]  # rows that share an id are one document
    rows += [(200 + i, LONG + "in four") for i in range(4)] + [(203, LONG + "in four")]  # four ids only
    rows += [(300, "z" * 200_000 + "\n" + LONG + "in five")] + [(301 + i, LONG + "IN FIVE ") for i in range(4)]
    check(spark, docs, rows)


def test_empty_table(spark, docs):
    assert ld.digests(docs([])).collect() == []


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.frombuffer(rng.bytes(16 * n), ld.KEY)
        index = ld.PerfectHash.build(keys)
        assert index.size == n and sorted(index.number(keys).tolist()) == list(range(n))
        again = ld.PerfectHash.unpacked(index.packed())
        assert (again.number(keys) == index.number(keys)).all()
        assert sum(len(x) for x in index.packed()) * 8 < 4 * n + 3000


def test_index_is_a_table_that_other_texts_can_probe(spark, docs):
    rows = [(i, "\n".join([LONG + str(i % 4), LONG + "of " + str(i)])) for i in range(30)]
    shards = {r["shard"]: ld.loaded(r) for r in ld.line_index(docs([(i, t, "en") for i, t in rows])).collect()}
    assert sum(s.index.size for s in shards.values()) == 34
    n = ld._sizes(docs([(i, t, "en") for i, t in rows]), "text")[1]

    def held(line):
        key = np.frombuffer(next(d for _, d in ld.line_keys(line)), ld.KEY)
        shard = shards.get(int(key["a"][0] % np.uint64(n)))
        found = shard.probe(key, 5) if shard else ([False], [0])
        return bool(found[0][0]), int(found[1][0])

    assert held(LONG + "2") == (True, 26) and held(LONG.upper() + "3 ") == (True, 27)
    assert not held(LONG + "of 5")[0] and not held("another line that no document of the index has")[0]
