"""Texts made of common passages: all links are found, and the pairs tried stay few."""

import random

from test_dedup import components

from wayfold.llm import jaccard


def template(n, seed=0):
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(30)] for k in range(40)]
    return [(i, " ".join(" ".join(passages[k]) for k in rng.sample(range(40), 5)), "en") for i in range(n)]


def test_template_texts(docs, monkeypatch):
    tried = {}
    links = jaccard._links

    def counted(sets, percent):
        out = links(sets, percent)
        tried[n] = sum(out[1])
        return out

    monkeypatch.setattr(jaccard, "_links", counted)
    for n in (400, 1600):
        rows = template(n)
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows).repartition(3)).collect()}
        if n == 400:
            assert found == components(rows)
    assert tried[1600] < 1600 * 20 and tried[1600] < 10 * tried[400]  # all pairs: 1.3 million, 16 times as many


def test_heavy_lists_and_copies_in_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2500)
    rng = random.Random(5)
    core = [f"c{k}" for k in range(60)]
    rows = []
    for i in range(150):
        t = core[:]
        for _ in range(i % 3):
            t[rng.randrange(60)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(t), "en"))
    rows += [(200 + k, rows[k][1], "en") for k in range(0, 150, 3)] + [(400, "word " * 30_000, "en"), (401, "word " * 29_000, "en")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows).repartition(7)).collect()}
    assert found == components(rows)


def test_ids_of_any_type_and_clashing_columns(spark):
    rows = [(1.5, "a b c d e f", "x", 1), (2.5, "A B c d e f", "y", 2), (3.5, None, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id double, text string, component_id string, n_shingles int")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert found == {1.5: (2, 1.5), 2.5: (2, 1.5), 3.5: (0, 3.5)}
