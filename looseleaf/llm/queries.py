"""Queries over the corpus operators with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, pii, quality_rules, secret_scan, simhash_dedup, substring_dedup, toxicity
from .common import documents, of_kinds, span_text
from .sentencepiece_codec import sentencepiece_codec

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def counts(spans: Column, kinds: list[str]) -> list[Column]:
    return [F.size(of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in kinds]


def digest(spans: Column, kinds: list[str]) -> Column:
    return F.sha2(span_text(of_kinds(spans, kinds)), 256)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_decisions(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words"
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
grams AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
lines AS (
  SELECT rid, doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT rid, doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE words > 0 GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT coalesce(doc_id, -1)) AS docs FROM d GROUP BY source),
often AS (
  SELECT l.source, l.norm FROM (SELECT source, norm, count(DISTINCT coalesce(doc_id, -1)) AS n FROM lines WHERE words > 0 GROUP BY source, norm) l
  JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE l.n > 10 AND l.n > 0.05::DOUBLE * h.docs),
gone AS (
  SELECT rid, count(DISTINCT l.norm) AS n_lines, sum(words) AS n FROM lines l
  JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY rid),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_removed_lines, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN gone USING (rid)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 30 AND n_words - n_removed_words >= 0.3::DOUBLE * n_words AS kept FROM g
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, kinds = F.col("spans"), secret_scan.BASE_KINDS
    return secret_scan.scan_secrets(documents(spark, sf_dir)).select(
        "doc_id", *counts(spans, kinds), digest(spans, kinds).alias("base_sha256"), span_text(spans).alias("spans")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, labels = F.col("base"), lambda *x: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda s: s["kind"]) for c in x]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return license_scan.scan_licenses(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base, F.col("matches")).alias("labels"),
        "score",
    )


def codec_digests(coded: DataFrame, *keep: str) -> DataFrame:
    return coded.select(
        *keep,
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(sentencepiece_codec(documents(spark, sf_dir), piece_model()), "doc_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(documents(spark, sf_dir))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select("doc_id", F.col("item").alias("item_id"), F.col("start").alias("first_word"), F.col("end").alias("end_word"), F.round("similarity", 6).alias("similarity"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.duplicate_passages(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, kinds = F.col("spans"), pii.BASE_KINDS
    return pii.pii_spans(documents(spark, sf_dir)).select(
        "doc_id", *counts(spans, kinds), digest(spans, kinds).alias("base_sha256"), span_text(spans).alias("spans"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_secret_scan": op2_secret_scan,
        "op3_license_scan": op3_license_scan,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_language_id": op5_language_id,
        "op6_simhash_dedup": op6_simhash_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_decontamination": op8_decontamination,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL}
