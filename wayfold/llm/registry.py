"""Queries of this subpackage: one ``opN_<name>`` per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import audio, jaccard, language, lexical, line_dedup, packing, pieces, suffix_dedup, token_counts, toxicity, vector_codes, vector_search, warc
from wayfold.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_decode(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_search.scaled(read(spark, sf_dir, "embeddings"))
    return vector_search.top_k(vectors, vectors.where("id % 50 = 0"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.aligned(read(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(read(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_ngram_jaccard, op3_best_fit_packing, op4_suffix_dedup, op5_sentencepiece, op6_language_id, op7_exact_top_k, op8_warc, op9_toxicity, op10_audio_fingerprints, op11_vector_codes, op12_lexical_search, op13_line_dedup, pipeline)
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _assigned(k: int) -> str:
    """SQL of the parts with their nearest entries of codebook c{k}, then of codebook c{k + 1}."""
    return f"""n{k} AS (SELECT p.vec_id, p.part, min(list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * 64 + c.entry) AS best FROM p JOIN c{k} c USING (part) GROUP BY ALL),
        a{k} AS (SELECT vec_id, part, best % 64 AS entry, best // 64 AS d FROM n{k})"""


def _moved(k: int) -> str:
    return f"""s{k} AS (SELECT part, entry, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS y FROM a{k} JOIN p USING (vec_id, part), range(1, (SELECT max(len(x)) + 1 FROM p)) r(i) GROUP BY ALL),
        m{k} AS (SELECT part, entry, list(y ORDER BY i) AS y FROM s{k} GROUP BY ALL),
        c{k + 1} AS (SELECT c.part, c.entry, coalesce(m.y, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (part, entry))"""


#: DuckDB SQL where it can express a query.
ORACLE_SQL: dict[str, str] = {
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f""",
    "op11_vector_codes": f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM v, range(16) r(part)),
        c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < 64),
        {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
        e AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (vec_id), h""",
    "op12_lexical_search": f"""
        WITH q AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        t AS (SELECT item_id, word, count(*) AS often FROM (SELECT item_id, unnest(w) AS word FROM q) GROUP BY ALL),
        d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        g AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
        m AS (SELECT doc_id, 100 - 25 + (25 * len(w) * docs) // total AS m FROM d, g WHERE len(w) > 0),
        p AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM t) GROUP BY ALL),
        f AS (SELECT word, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, g GROUP BY word, docs),
        s AS (SELECT item_id, doc_id, CAST(sum(often * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM t JOIN f USING (word) JOIN p USING (word) JOIN m USING (doc_id) GROUP BY ALL),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op13_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT doc_id, line, i, last IS NULL OR last = doc_id AS kept FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
}
