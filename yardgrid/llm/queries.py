"""One query per text operator, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardgrid.llm import bpe, common, decontamination, divergence, fingerprint, language, near_dedup, prefix_trie, quality, secrets, sharding, substrings, token_counts, toxicity
from yardgrid.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Register a query under the name of its function."""
    QUERIES[run.__name__] = run
    return run


@query
def op7_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards, counts at most one apart."""
    docs = common.documents(spark, folder)
    narrow = docs.select(
        "doc_id",
        (F.octet_length(common.filled("text")) + 1).cast("bigint").alias("size"),
        F.crc32(common.filled("text").cast("binary")).alias("text_crc32"),
    )
    return sharding.assign_shards(narrow, "doc_id", 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: base patterns and literals of sensitive names."""
    docs = common.documents(spark, folder).select("doc_id", "text")
    return secrets.find_secrets(docs).select("doc_id", "found.*")


@query
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Multiset fingerprints of all documents and of their edited texts."""
    return fingerprint.compare_with_next(common.documents(spark, folder))


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram tokens of every document under the pieces of a public vocabulary."""
    docs = common.documents(spark, folder).select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(docs, path).select("doc_id", "n_tokens")


@query
def op10_shared_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages that several documents share, in every document that has them."""
    return substrings.shared_passages(common.documents(spark, folder))


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = common.documents(spark, folder)
    models = language.fit_dictionaries(docs, ~common.held_out())
    return language.identify(docs.select("doc_id", "text"), models).select(
        "doc_id", common.held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"),
        "language.score", "language.margin", "language.rejected",
    )


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows that are not held out."""
    docs = common.documents(spark, folder)
    labels = common.table(spark, folder, "labels")
    rows = toxicity.examples(docs, labels, ~common.held_out())
    net = toxicity.train(rows)
    limits = toxicity.thresholds(net, rows)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text", "lang"), net)
    return toxicity.decide(scored, limits).select(
        "doc_id", common.held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "toxic_by_lang",
    )


@query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return near_dedup.near_duplicates(common.documents(spark, folder))


@query
def op2_contaminated(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that occur in documents."""
    return decontamination.contaminated(
        common.documents(spark, folder), common.table(spark, folder, "benchmark")
    )


@query
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document under a public byte-level vocabulary, and their decoding."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(common.documents(spark, folder), path, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("decimal", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document: its counts and the verdict of the ordered rules."""
    docs = common.documents(spark, folder).select("doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = quality.estimate_order(docs, report=counts)
    found = quality.apply_rules(docs, order, report=counts).select("doc_id", "quality.*")
    return found.select(
        "doc_id", *counts,
        F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words").alias("base_failed"),
        "kept",
    )


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Distances between the sources of each language, and the terms of each source."""
    return divergence.source_divergence(common.documents(spark, folder))


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations."""
    conversations = common.table(common.prepare(spark), folder, "conversations")
    return prefix_trie.prefix_trie(conversations, prefix_trie.rebuilt)
