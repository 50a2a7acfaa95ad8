"""Queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, mixing, neardup, paragraphs, pii, quality, secrets, shards, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "_q_"
    found = quality.judge(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", *[F.col(f"{p}{x}").alias(x) for x in (*quality.METRICS, "base_failed", "kept")])


QUERIES = {f.__name__: f for f in (op1_pii, op2_substring_dedup, op3_toxicity, op4_warc, op5_sharding, op6_near_dedup, op7_secrets, op8_mixing, op9_decontamination, op10_quality)}

WORD = r"[^\x20\x09-\x0D]+"

#: Plain SQL that DuckDB runs on the same tables. What it can't say (offsets with checksums, seeded draws of
#: other hashes, learnt scores, alignments) has none and is tested against brute force.
ORACLES: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS size, sha1(body) AS digest FROM p),
 h AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY digest, size) END AS head FROM d)
SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN head IS DISTINCT FROM page_id AND head IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN head IS DISTINCT FROM page_id THEN head END AS refers_to FROM h""",
    "op6_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
 e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)), r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x), m AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id, d.doc_id = component AS kept FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('mix-1|' || doc_id) AS ord FROM documents),
 s AS (SELECT source, sum(size) AS whole, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
 c AS (SELECT *, 2 * whole / w AS ratio, 1.5 * sum(whole) OVER () AS total FROM s), o AS (SELECT *, coalesce(sum(2 * whole) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_ FROM c WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 k AS (SELECT capped, open_ FROM o WHERE (total - capped) / open_ <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
 t AS (SELECT source, whole, CASE WHEN (total - k.capped) / k.open_ > ratio THEN CAST(2 * whole AS DOUBLE) ELSE CAST(total - k.capped AS DOUBLE) * w / k.open_ END AS target FROM o, k),
 g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS gives FROM t), f AS (SELECT *, CASE WHEN whole > 0 THEN gives // CAST(whole AS BIGINT) ELSE 0 END AS full_ FROM g),
 x AS (SELECT d.*, whole, target, full_, gives - full_ * whole AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, CAST(whole AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, CAST(full_ * size + greatest(0, least(size, rest - at_)) AS BIGINT) AS taken FROM x""",
    "op10_quality": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
 g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM d WHERE len(w) >= 3), r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
 v AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(3) q(j) GROUP BY doc_id),
 m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM d LEFT JOIN v ON v.doc_id = d.doc_id),
 f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  n_symbols > {quality.MAX_SYMBOLS_PER_WORD} * n_words AS major_failed, (n_words > 0 AND (word_chars / n_words < {quality.MEAN_WORD_CHARS[0]} OR word_chars / n_words > {quality.MEAN_WORD_CHARS[1]}))::INT + (n_dup_lines > {quality.MAX_DUP_LINES} * n_lines)::INT
  + (100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT_MINOR} * n_words)::INT AS minor FROM m),
 h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR major_failed OR minor > 0) AS f FROM f GROUP BY source), a AS (SELECT sum(n) AS n, greatest(least(sum(f) / sum(n), 1 - 1e-6), 1e-6) AS mean, count(*) AS k, sum(n * n) AS n2 FROM h),
 s AS (SELECT any_value(a.n) AS n, any_value(mean) AS mean, any_value(k) AS k, any_value(n2) AS n2, sum(h.n * pow(h.f / h.n - mean, 2)) AS s FROM h, a), b AS (SELECT mean, CASE WHEN k > 1 AND n > n2 / n THEN (s - (k - 1) * mean * (1 - mean)) / (n - n2 / n) ELSE 0 END AS between_ FROM s),
 p AS (SELECT mean, CASE WHEN between_ > 0 THEN least(greatest(mean * (1 - mean) / between_ - 1, 1), 10000) ELSE 10000 END AS weight FROM b), j AS (SELECT source, (f + mean * weight) / (n + weight) > {quality.MAX_HOST_RATE} AS bad FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT major_failed AND minor <= CASE WHEN bad THEN 0 ELSE 1 END AS kept FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source""",
}
