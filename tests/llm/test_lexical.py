import math
import random
import re
from collections import Counter

import pytest

from wayfold.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=20):
    found = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if i is not None and t]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, total = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        asked, scored = TERM.findall((text or "").translate(LOWER)), []
        for i, c, n in found:
            m = 100 - 25 + ((25 * n * n_docs) // total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, n int")
    return d, spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, score double")


def check(spark, docs, items, **kw):
    found = lexical.search(*frames(spark, docs, items), **kw)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, items)


@pytest.fixture
def words():
    rng = random.Random(7)
    vocabulary = ["w%d" % int(rng.paretovariate(0.7)) for _ in range(3000)]
    return lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))


def test_against_brute_force_over_many_windows(spark, words, monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 64)
    monkeypatch.setattr(lexical, "EACH", 300)
    docs = [(i * 1_000_003 % 10_007, words(1 + i % 50)) for i in range(900)]
    check(spark, docs, [(i, words(12)) for i in range(30)])


def test_cases(spark, words):
    docs = [(1, None), (2, ""), (3, "-- !"), (4, "Één été ÉTÉ x_y Zz9"), (5, "zz9 zz9 X y"), (6, "zz9 zz9 x Y"), (7, "zz9"), (None, "zz9 zz9"), (8, "été " * 3000), (9, "\x7fa\x80b")]
    docs += [(20 + i, "common " + ("rare" if i == 3 else "")) for i in range(40)]
    items = [(1, "ZZ9 zz9 x"), (2, "été"), (3, None), (4, ""), (5, "absent"), (6, "common common rare"), (6, "Y"), (7, "a\x80b")]
    check(spark, docs, items)


def test_equal_ids_and_repeated_rows_are_documents_of_their_own(spark):
    check(spark, [(1, "a b"), (1, "a b"), (1, "a"), (2, "a b"), (3, "c"), (4, "c c")], [(1, "a b c")])


def test_empty_tables(spark):
    assert lexical.search(*frames(spark, [], [(1, "a")])).collect() == []
    assert lexical.search(*frames(spark, [(1, "a")], [])).collect() == []
    assert lexical.search(*frames(spark, [(1, None)], [(1, "a")])).collect() == []


def test_items_beyond_one_pass(spark, words, monkeypatch):
    monkeypatch.setattr(lexical, "ASKED", 25)
    check(spark, [(i, words(30)) for i in range(200)], [(i, words(15)) for i in range(9)])


def test_long_texts_are_cut_between_terms():
    raw = b"ab, " * 1000 + b"x" * 500 + b" end"
    for size in (1, 7, 64, 10_000):
        assert b"".join(lexical.parts(raw, size)) == raw
        assert [t for p in lexical.parts(raw, size) for t in lexical._TERM.findall(p)] == lexical._TERM.findall(raw)


def test_lengths_beyond_64_bits():
    import numpy as np

    assert lexical.lengths(np.array([10**7, 3]), 10**12, 10**15).tolist() == [75 + 25 * 10**7 * 10**12 // 10**15, 75]
