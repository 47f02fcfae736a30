"""Registered queries of this subpackage: opN_<name>(spark, sf_dir), and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import table
from barflow.llm.decontamination import decontamination
from barflow.llm.fill_in_middle import fill_in_middle, restored
from barflow.llm.hard_negatives import hard_negatives
from barflow.llm.license_scan import license_scan
from barflow.llm.lm_scoring import lm_scoring
from barflow.llm.ngram_join import ngram_join
from barflow.llm.oracle import OP5, OP8, OP10, OP11, OP13
from barflow.llm.packing import packing
from barflow.llm.quality_classifier import quality_classifier
from barflow.llm.quality_rules import quality_rules
from barflow.llm.secret_scan import secret_scan
from barflow.llm.suffix_dedup import suffix_dedup
from barflow.llm.token_counts import token_counts
from barflow.llm.warc import crawl, resolve_revisits

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's second visit resolved: its response, the verdict, the body's size and digest, and the merged headers."""
    found = resolve_revisits(crawl(table(spark, sf_dir, "pages")))
    header = lambda k: F.coalesce(F.element_at("headers", k), F.lit("-"))
    return found.select(
        F.col("id").alias("page_id"), "canonical", "response_id", "verdict", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.md5(F.col("body").cast("binary")).alias("body_md5"),
        F.concat_ws(";", *(header(k) for k in ("age", "cache-control", "content-length", "content-type"))).alias("merged"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("found")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("failed_rule")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the fixed forms, their digest, and all spans as text."""
    found = secret_scan(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(of(kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, the output's digest, and that of the text rebuilt from the output and its form."""
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_token_counts, op3_lm_scoring, op4_quality_classifier, op5_ngram_join, op6_warc_revisits, op7_license_scan, op8_decontamination, op9_suffix_dedup, op10_quality_rules, op11_hard_negatives, op12_secret_scan, op13_fill_in_middle)
}

#: The crawl of op6, by an as-of join.
_OP6 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, md5(coalesce(html, '')) AS tag,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages
), q AS (
  SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept
  FROM p
), c AS (
  SELECT page_id, html, tag,
    regexp_replace(lower(regexp_extract(path, '^([^/]*)', 1)), ':(80|443)$', '')
      || regexp_replace(regexp_extract(path, '^[^/]*(.*)$', 1), '/+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical
  FROM q
), j AS (
  SELECT a.page_id, a.canonical, a.tag, b.page_id AS rid, b.tag AS rtag, b.html AS body
  FROM c a ASOF LEFT JOIN c b ON a.canonical = b.canonical AND a.page_id * 2 + 1001 > b.page_id * 2
)
SELECT page_id, canonical, CASE WHEN tag = rtag THEN rid END AS response_id,
  CASE WHEN rid IS NULL THEN 'no response' WHEN tag = rtag THEN 'resolved' ELSE 'changed' END AS verdict,
  CASE WHEN tag = rtag THEN CAST(octet_length(encode(body)) AS BIGINT) ELSE 0 END AS n_bytes,
  CASE WHEN tag = rtag THEN md5(body) END AS body_md5,
  CASE WHEN tag = rtag THEN '0;max-age=600;' || CAST(octet_length(encode(body)) AS VARCHAR) || ';text/html' ELSE '0;max-age=600;0;-' END AS merged
FROM j
"""

ORACLE: dict[str, str] = {"op5_ngram_join": OP5, "op6_warc_revisits": _OP6, "op8_decontamination": OP8, "op10_quality_rules": OP10, "op11_hard_negatives": OP11, "op13_fill_in_middle": OP13}
