"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import fingerprints, html_extract, mixing, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filters
from cadenza.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), TOKENIZER)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = suffix_dedup.remove_repeats(docs).select("doc_id", "removal.*")
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return linked.select("doc_id", "n_shingles", "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages carry no time: a page counts as fetched on day page_id mod 365 of 2024."""
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    out = url_filters.evaluate(pages.withColumn("fetched", day), url_filters.entries(spark))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched", "first_since")})


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_html_extraction,
        op2_best_fit_packing,
        op3_fingerprints,
        op4_suffix_dedup,
        op5_token_counts,
        op6_ngram_join,
        op7_quality_rules,
        op8_url_filters,
        op9_mixing_sources,
        op10_quality_classifier,
    )
}

_LOG = ", ".join(f"('{n}', '{k}', '{e}', DATE '{d}', '{a}')" for n, k, e, d, a in url_filters.ENTRIES)

SQL: dict[str, str] = {
    "op7_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (
  SELECT rid, i, array_to_string(w[i + 1:i + 8], ' ') AS g
  FROM (SELECT rid, w, unnest(range(0, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cover AS (
  SELECT rid, sum(n) AS n_repeat_words FROM (
    SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS n FROM twice)
  GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM d LEFT JOIN l USING (rid) LEFT JOIN cover USING (rid)),
b AS (
  SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT)
    + 4 * CAST(10 * n_symbols > 3 * n_words AS BIGINT) + 8 * CAST(10 * n_dup_lines > 3 * n_lines AS BIGINT)
    + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 20 * n_words AS BIGINT) AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits, n_lines FROM b""",
    "op8_url_filters": rf"""
WITH log(list, kind, key, day, action) AS (VALUES {_LOG}),
c AS (
  SELECT list, kind, key, day, action FROM log
  QUALIFY coalesce(lag(action) OVER (PARTITION BY list, kind, key ORDER BY day) <> action, true)),
v AS (
  SELECT * FROM (
    SELECT list, kind, key, action, day AS since, lead(day) OVER (PARTITION BY list, kind, key ORDER BY day) AS until FROM c)
  WHERE action = 'add'),
p AS (
  SELECT row_number() OVER () AS rid, page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched,
         lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS host,
         regexp_replace(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
m AS (
  SELECT rid, list, since FROM p JOIN v
    ON since <= fetched AND (until IS NULL OR fetched < until)
   AND (kind = 'host' AND host = key
        OR kind = 'domain' AND (host = key OR ends_with(host, '.' || key))
        OR kind = 'path' AND (host || path = key OR starts_with(host || path, key || '/'))))
SELECT page_id, url, CAST(fetched AS VARCHAR) AS fetched, count(list) > 0 AS blocked, count(list) AS n_entries,
       coalesce(string_agg(DISTINCT list, ',' ORDER BY list), '') AS lists, CAST(min(since) AS VARCHAR) AS first_since
FROM p LEFT JOIN m USING (rid) GROUP BY rid, page_id, url, fetched""",
}
