"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import alignment, best_fit, bpe, fingerprints, html_extract, line_dedup, near_dedup, quality_classifier, quality_rules, sharding, url_filters, warc, whitening
from rollcall.llm.common import read

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The rank file that op3 reads by default; a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The two vocabularies that op12 aligns by default; parameters of the operator.
JSON_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


@register
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines")


@register
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = best_fit.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return best_fit.best_fit_packing(counted, F.col("n_tokens"))


@register
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=False)


@register
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.importance_resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


@register
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(read(spark, sf_dir, "pages").select("page_id", "url"), read(spark, sf_dir, "labels"))


@register
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "warc_date")


@register
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(JSON_A), public_tokenizers.path(MODEL_B))


@register
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: The notices' phrases of the SQL form (stated here by themselves).
_BOILERPLATE = (
    r"all rights reserved|terms of (use|service)|privacy policy|cookie policy|(we|site) uses? cookies|accept (all )?cookies"
    r"|enable javascript|javascript is (disabled|required)|subscribe to our|sign up for our|click here to|skip to (main )?content"
    r"|licen[sc]ed under|copyright ©|copyright \(c\)"
)

#: Words by Spark's and DuckDB's common regular expressions; verdicts from literal thresholds, not from the operator's parameters.
ORACLE["op1_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT rid, doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w
  FROM d
), f AS (
  SELECT rid, doc_id, t, lines, w, list_filter(lines, lambda x:
      NOT regexp_matches(x, '[\pL\pN]')
      OR (len(regexp_extract_all(x, '[#*$%&|<>]')) >= 3 AND len(regexp_extract_all(x, '[#*$%&|<>]')) >= 1.0 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
      OR ((length(x) - length(replace(x, '!!', ''))) / 2 >= 3 AND (length(x) - length(replace(x, '!!', ''))) / 2 >= 0.5 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
      OR (len(regexp_extract_all(x, '[|»›•·→]')) >= 3 AND len(regexp_extract_all(x, '[|»›•·→]')) >= 0.25 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
      OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 30 AND regexp_matches(x, 'BOILERPLATE', 'i'))) AS bad
  FROM l
), p AS (
  SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM l WHERE len(w) >= 5
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS c FROM p
), r AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM g WHERE c >= 2) GROUP BY rid
), m AS (
  SELECT f.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(bad) AS BIGINT) AS n_failed_lines,
         coalesce(list_sum(list_transform(bad, lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')))), 0) AS lost
  FROM f LEFT JOIN r ON r.rid = f.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.6 * word_chars AS kept, n_lines, n_failed_lines
FROM m
""".replace("BOILERPLATE", _BOILERPLATE)

ORACLE["op8_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     m AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(p.h, CAST((i // 8) * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to,
       array_to_string(list_reverse(string_split(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',')
         || ')' || lower(regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's')) AS url_key,
       strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date
FROM p JOIN m USING (h)
"""

ORACLE["op11_line_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT rid, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d
), k AS (
  SELECT *, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key
  FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), j AS (
  SELECT k.rid, k.doc_id, k.line, k.pos, o.key IS NOT NULL AND k.doc_id <> o.owner AS gone FROM k LEFT JOIN o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
