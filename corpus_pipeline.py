"""A cleaning pipeline of the text operators; every stage works on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardgrid.llm import bpe, common, decontamination, language, near_dedup, secrets
from yardgrid.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the classifier learns from all labelled rows."""
    common.prepare(spark)
    return language.keep_identified(docs, language.fit_dictionaries(docs, F.lit(True)))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates, that of the smallest id.

    Rows are told apart by id and text; of repeated rows one stays. Documents without an id cannot
    be compared and stay.
    """
    common.prepare(spark)
    return near_dedup.keep_representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; the text alone decides, whatever the id."""
    common.prepare(spark)
    key = common.fresh(docs, "_text_key")
    keyed = docs.withColumn(key, F.xxhash64(common.filled("text")))
    found = decontamination.contaminated(keyed, common.table(spark, sf_dir, "benchmark"), key=key)
    leaks = found.select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets masked and their lengths brought up to date."""
    common.prepare(spark)
    masked = secrets.redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and the digest of the text they decode to."""
    common.prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", redacted),
    ("byte_bpe", tokenized),
]

# The models have no SQL form; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage reads what its predecessor stored."""
    docs = common.documents(spark, sf_dir)
    *cleaning, (_, last) = STAGES
    for _, stage in cleaning:
        docs = settle(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
