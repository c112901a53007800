import corpus_pipeline
from test_dedup import components, repeated

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text, r.lang) for r in df.select("doc_id", "text", "lang").collect()]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [rows_of(docs)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(rows_of(docs) if k < 4 else docs.collect())
    start, clean, told, alone, cut, pieces = kept
    words = set("moron loser worthless clown disgusting idiot pathetic stupid trash scum".split())
    toxic = lambda t: bool(words & set((t or "").lower().replace(".", " ").replace(",", " ").split()))
    gone = {i for i, _, _ in start} - {i for i, _, _ in clean}
    assert sum(toxic(t) for i, t, _ in start if i not in gone) <= 3 and len(gone) < 0.3 * len(start)
    assert all(t and len(t) < 400 for i, t, _ in clean if i not in {j for j, _, _ in told} and t and len(set(t.split())) > 20) and len(told) > 0.95 * len(clean)
    assert {i for i, _, _ in alone} == {i for i, (_, c) in components(told).items() if i == c}
    left = {i: len((t or "").encode()) for i, t, _ in cut}
    for i, size, removed, _, _ in repeated(alone):
        assert size - removed - 6 * 4 <= left[i] <= size - removed
    assert sorted({p.doc_id for p in pieces}) == sorted(i for i, _, _ in cut)
    assert max(p.offset + p.length for p in pieces) <= 2048
