"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import embedding_dedup, exact_dedup, html_text, mixing, near_dedup, packing, quality, substring_dedup, token_counts, warc
from millrace.llm.common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.public_tokenizer())


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), packing.public_tokenizer())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(table(spark, sf_dir, "embeddings"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict:
    found = (
        op1_minhash_near_dedup, op2_best_fit_packing, op3_token_counts, op4_substring_dedup, op5_embedding_near_dedup,
        op6_source_mixing, op7_exact_dedup, op8_quality_classifier, op9_html_extraction, op10_warc,
    )
    return {f.__name__: f for f in found}


# shingles of five words, all pairs that share one, and the least id within reach
_OP1 = r"""
WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s
  FROM w),
bag AS (SELECT id, s, count(*) AS c FROM sh GROUP BY ALL),
tot AS (SELECT id, sum(c) AS n FROM bag GROUP BY id),
pairs AS (SELECT a.id AS u, b.id AS v, sum(least(a.c, b.c)) AS m FROM bag a JOIN bag b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN tot x ON x.id = u JOIN tot y ON y.id = v WHERE m >= 0.8 * (x.n + y.n - m)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT id, id AS c FROM w UNION SELECT r.id, b.v FROM reach r JOIN both_ways b ON r.c = b.u),
least_id AS (SELECT id, min(c) AS class_id FROM reach GROUP BY id)
SELECT id AS doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, id = class_id AS kept FROM least_id
"""

# for the constructs that the pages have: one article, its blocks between p and h1 tags
_OP9 = r"""
WITH art AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>', chr(1), 'g') AS h FROM pages),
bare AS (SELECT page_id, url, regexp_replace(replace(h, '<br>', ' '), '<[^>]*>', '', 'g') AS h FROM art),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(h, '&#x27;', chr(39)), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS h FROM bare),
lines AS (SELECT page_id, url, list_filter(list_transform(string_split(h, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS x FROM plain)
SELECT CAST(page_id AS BIGINT) AS page_id, url, array_to_string(x, chr(10)) AS text, length(array_to_string(x, chr(10))) AS n_chars FROM lines
"""

_OP6 = r"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM sized GROUP BY source),
weighed AS (SELECT *, CASE idx % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM per),
filled AS (
  SELECT *, coalesce(sum(s * 2) OVER (ORDER BY s / CAST(w AS DOUBLE), idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY s / CAST(w AS DOUBLE), idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(s) OVER () AS every
  FROM weighed),
levelled AS (SELECT *, (CAST(every AS DOUBLE) * 1.5 - CAST(before AS DOUBLE)) / CAST(rest AS DOUBLE) AS level FROM filled),
water AS (SELECT arg_min(level, s / CAST(w AS DOUBLE) + idx * 1e-9) AS level FROM levelled WHERE level * w <= s * 2),
targets AS (
  SELECT source, s, least(CAST(s * 2 AS DOUBLE), coalesce((SELECT level FROM water) * w, CAST(s * 2 AS DOUBLE))) AS target FROM levelled),
quotas AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM targets),
placed AS (
  SELECT d.doc_id, d.size, q.s, q.target, q.quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, s AS source_size, target,
       CAST(CASE WHEN s = 0 THEN 0 ELSE quota // s * size + greatest(0, least(size, quota % s - before)) END AS BIGINT) AS taken
FROM placed
"""

_OP7 = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents),
won AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size FROM keyed)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(keep_id AS BIGINT) AS keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM won
"""

_OP10 = r"""
WITH paid AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
won AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM paid),
coded AS (
  SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(hex, CAST(5 * g + 1 AS INTEGER), 5) AS INTEGER)) AS fives FROM won)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM coded
"""


def oracle_sql() -> dict[str, str]:
    """Equivalents in DuckDB's SQL, where SQL can express the query."""
    return {"op1_minhash_near_dedup": _OP1, "op6_source_mixing": _OP6, "op7_exact_dedup": _OP7, "op9_html_extraction": _OP9, "op10_warc": _OP10}
