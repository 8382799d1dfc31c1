"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespan.llm import _shared, jaccard, lm, mixing, packing, quality, secrets, substring, token_count, token_file, topk


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared.new_path(spark, "token-file")
    token_file.write(_documents(spark, sf_dir), path, tokenizer_path(), end_id=2)
    return token_file.digest(spark, path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_documents(spark, sf_dir), tokenizer_path(), limit=1024)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_documents(spark, sf_dir), n=4, percent=85)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_first(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "lost_share", "base_failed", "kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path(), end_id=1, capacity=2048)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50, scale=256)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_documents(spark, sf_dir)).taken()


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir)).select("doc_id", "n_candidates", "n_secrets", F.array_join("spans", ",").alias("spans"), "redacted_sha256")


QUERIES = {f.__name__: f for f in (op1_deleted_interpolation, op2_token_file, op3_token_counts, op4_ngram_jaccard, op5_substring_dedup, op6_line_first, op7_packing, op8_exact_top_k, op9_mixing, op10_secret_scan)}

#: Where DuckDB can express the whole result in reasonable time; the other queries are tested against plain Python.
ORACLE_SQL = {
    "op4_ngram_jaccard": r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
    SELECT d.doc_id, count(s) AS n_shingles FROM docs d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n_shingles, y.n_shingles
    HAVING 100 * count(*) >= 85 * (x.n_shingles + y.n_shingles - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM docs
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, n_shingles, component_id FROM sizes JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
""",
    "op5_substring_dedup": r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)
), hits AS (
    SELECT doc_id, i FROM windows JOIN (SELECT g, min(doc_id) AS least FROM windows GROUP BY g) USING (g) WHERE least < doc_id
), gone AS (
    SELECT DISTINCT doc_id, i + k AS p FROM hits, (SELECT unnest(range(0, 50)) AS k)
), words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
""",
    "op6_line_first": r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
    SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
), repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), (SELECT unnest(range(0, 3)) AS k) GROUP BY doc_id
), lines AS (
    SELECT doc_id, k, line, trim(line, e' \t\n\r\x0b\x0c') AS body, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS dup
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), parts AS (
    SELECT *, rtrim(body, '"'')]}”’»') AS core, string_split_regex(body, '\s+') AS spoken, length(regexp_replace(body, '[^.!?…。！？]*$', '')) AS ended FROM lines
), judged AS (
    SELECT doc_id, length(line) AS n, dup,
        NOT regexp_matches(core, '[.!?…。！？]$') AND 2 * ended < length(body)
        OR len(regexp_extract_all(body, '\s[|>»•·]\s|\|')) >= 3
        OR len(regexp_extract_all(body, '[#*$%&|<>]')) > 0.1 * length(body)
        OR regexp_matches(body, '\p{Lu}') AND NOT regexp_matches(body, '\p{Ll}')
        OR length(body) >= 8 AND len(regexp_extract_all(body, '\p{Lu}')) > 0.7 * greatest(1, len(regexp_extract_all(body, '\p{L}')))
        OR len(spoken) >= 10 AND len(list_filter(range(1, len(spoken)), lambda i: spoken[i] = spoken[i + 1])) > 0.5 * len(spoken)
        OR regexp_matches(lower(body), 'all rights reserved|privacy policy|terms of use|terms of service|cookie policy|accept cookies|sign up|log in|subscribe to|click here|read more|share this|skip to content|back to top|enable javascript|lorem ipsum') AND len(spoken) <= 12 AS bad
    FROM parts
), sums AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (dup OR bad) AS n_bad_lines, coalesce(sum(n) FILTER (dup OR bad), 0) AS lost, sum(n) AS n FROM judged GROUP BY doc_id
), facts AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines,
        CASE WHEN n > 0 THEN CAST(lost AS DOUBLE) / CAST(n AS DOUBLE) ELSE 1.0::DOUBLE END AS lost_share
    FROM docs LEFT JOIN repeated USING (doc_id) LEFT JOIN sums USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_share <= 0.5 AS kept FROM facts
""",
    "op8_exact_top_k": """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
