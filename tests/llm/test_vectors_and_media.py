import hashlib

import numpy as np
import pytest

from wayfold.llm import audio, vector_search, warc


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, every=50, k=5):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n", [3, 120])
def test_top_k(spark, monkeypatch, n):
    monkeypatch.setattr(vector_search, "BLOCK", 32)
    monkeypatch.setattr(vector_search, "QUERIES", 2)
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 4), 1)], 0) for i in range(n)]
    rows += [(500, None, 0), (501, [1.0, None, 0.0, 0.0], 0), (502, [float("nan"), 0.0, 0.0, 0.0], 0), (550, [float("inf"), 0.0, 0.0, 0.0], 0)]
    v = vector_search.scaled(vectors(spark, rows))
    found = sorted(map(tuple, vector_search.top_k(v, v.where("id % 50 = 0")).collect()))
    assert found == brute(rows)


def test_top_k_of_nothing(spark):
    v = vector_search.scaled(vectors(spark, []))
    assert vector_search.top_k(v, v).count() == 0


# ---- archives


def test_archives(spark):
    big, page = "<p>" + "x" * 200, "<html>é\r\n\r\nWARC/1.1\n</html>" + "y" * 100
    rows = [(1, "http://a/ b", page), (2, None, page), (3, "http://ü/", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (9, "u", page), (9, "u", page), (None, "u", big), (1, "v", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(map(tuple, warc.archived(pages).collect()), key=str)
    wanted = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if h == html and j is not None]
        again = i is not None and len(raw) >= 100 and min(same) != i
        wanted.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert found == sorted(wanted, key=str)
    assert warc.archived(pages.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_legacy_archives(version):
    records = [warc.ArcRecord("http://a/x", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\n<p>\n\n"), warc.ArcRecord("dns:b", "1.2.3.4", "2001", "text/dns", b"")]
    raw = warc.arc_header(version, "old.arc", "20010203040506") + b"".join(warc.arc_record(version, r) for r in records)
    opening, *found = warc.parse_arc(raw)
    assert opening.url == "filedesc://old.arc"
    assert [(r.url, r.ip, r.date, r.content_type, r.body) for r in found] == [(r.url, r.ip, r.date, r.content_type, r.body) for r in records]
    made = b"".join(warc.to_warc(r) for r in (opening, *found))
    heads = [h for h, _ in warc.parse_warc(made)]
    assert [h["warc-type"] for h in heads] == ["warcinfo", "response", "resource"]
    assert heads[1]["warc-date"] == "2001-02-03T04:05:06Z" and heads[2]["warc-date"] == "2001-01-01T00:00:00Z"
    assert heads[1]["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"<p>\n\n").hexdigest()
    assert heads == [h for h, _ in warc.parse_warc(b"".join(warc.to_warc(r) for r in (opening, *found)))]
    for broken in (raw[:-3], raw.replace(b" 200 - -", b"") if version == 2 else raw.replace(b"1.2.3.4 ", b""), b"no header"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(broken))


# ---- audio


def tune(seed, seconds=4.0):
    rng = np.random.default_rng(seed)
    notes = rng.integers(-12, 12, 40)
    t = np.arange(int(seconds * audio.RATE))
    f = 440 * 2.0 ** (notes[(t * 40 // len(t))] / 12)
    return (0.5 * np.sin(2 * np.pi * np.cumsum(f) / audio.RATE)).astype(np.float32)


def test_copies_align_and_others_do_not(spark):
    base = tune(1)
    rng = np.random.default_rng(0)
    cut = base[5 * audio.HOP :]
    rows = [(0, base), (1, cut), (2, base + rng.normal(0, 0.01, len(base)).astype(np.float32)), (3, tune(2)), (4, tune(3)), (5, base), (6, None), (7, base[:100]), (8, np.zeros(20000, np.float32)), (9, np.zeros(20000, np.float32))]
    df = spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in rows], "id long, samples array<float>")
    prints = audio.classes(audio.fingerprints(df, "id", "samples")).cache()
    cls = {r.id: r.cls for r in prints.collect()}
    assert cls[0] == cls[5] and cls[6] is None and cls[7] is None and cls[8] == cls[9]
    found = {(r.q, r.c): r for r in audio.alignments(prints, prints.where("id = 0")).collect()}
    assert {c for _, c in found} == {cls[0], cls[1], cls[2]}
    assert found[(cls[0], cls[1])].offset == 5 and found[(cls[0], cls[1])].rate < 0.05
    own = {(r.q, r.c) for r in audio.alignments(prints, prints.where("id = 8")).collect()}
    assert own == {(cls[8], cls[8])}


def test_recordings_of_vectors(spark):
    rng = np.random.default_rng(4)
    same = [float(x) for x in rng.normal(0, 0.2, 64)]
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 64)], 0) for i in range(1, 8)] + [(100, same, 0), (150, same, 0), (200, None, 0), (201, [], 0), (202, [float("nan")] * 64, 0), (203, [None] * 64, 0)]
    found = {r.vec_id: r for r in audio.aligned(vectors(spark, rows)).collect()}
    assert len(found) == len(rows)
    assert found[150].first_query == 100 and found[150].error_rate == 0.0 and found[100].n_queries == 1
    assert found[1].n_queries == 0 and found[200].n_items == 0 and found[201].cls is None
    assert audio.aligned(vectors(spark, [])).count() == 0


def test_areas_from_the_integral_image():
    x = tune(7)
    c = audio.chroma(x)
    items = audio.fingerprint(x)
    kind, low, height, width, first, threshold = audio.filters()[0]
    level = np.log1p(20 * c[first : first + width, low : low + height].mean()) - np.log1p(20 * c[: audio.SPAN].mean())
    step = int(np.searchsorted([-threshold, 0, threshold], level, "right"))
    assert items[0] >> 30 == step ^ step >> 1
