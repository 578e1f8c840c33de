"""Corpus pipeline over `documents`: each stage works on all rows that the one before kept.

All stages but the last return the columns of `documents`. A driver may write each stage's rows as Parquet and read
them again for the next; run() does the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from looseleaf.llm import decontaminate, quality_rules, secret_scan, shingle_dedup, simhash_dedup
from looseleaf.llm.common import documents, stored
from looseleaf.llm.queries import codec_digests, piece_model
from looseleaf.llm.sentencepiece_codec import sentencepiece_codec


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines are taken out of the others."""
    return quality_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word shingle similarity of 0.8 or more, the one with the smallest id stays.

    SimHashes and their Golay keys propose the pairs, the exact similarity decides.
    """
    return simhash_dedup.one_of_each(docs, group=shingle_dedup.similar_groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, in plain or encoded text, are masked; all documents stay."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    coded = sentencepiece_codec(docs, piece_model(), ["doc_id", "lang", "source"])
    return codec_digests(coded, "doc_id", "lang", "source", "ids")


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("sentencepiece", tokens),
]

#: SQL can express neither fingerprints by XXH64 nor the segmentation; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
