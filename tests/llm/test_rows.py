"""What stages and pair operators do with ids that are missing, repeated or shared by texts."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from yardgrid.llm import common, fingerprint, near_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLDER = "/root/testdata/sf0.001"


def words(seed, n=120):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def near(text):
    return " ".join([*text[:60], "changed", *text[61:]])


def test_two_texts_under_one_id_do_not_link_their_classes(spark):
    common.prepare(spark)
    a, b = words(1), words(2)
    rows = [(1, near(a)), (2, " ".join(a)), (2, " ".join(b)), (3, near(b)), (None, " ".join(a)), (None, " ".join(a))]
    rows += [(7, "one row twice")] * 2 + [(9, "one row twice"), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).withColumns(
        {"digest": F.lit("x"), "represents": F.lit(1), "_digest": F.lit(2), "_text_key": F.lit(3)}
    )
    found = sorted(map(tuple, near_dedup.near_duplicates(docs).select("doc_id", "class_id", "copy_of", "represents").collect()))
    assert found == sorted([
        (1, 1, 1, True), (2, 1, 2, False), (2, 2, 2, True), (3, 2, 3, False), (7, 7, 7, True), (7, 7, 7, True),
        (9, 7, 7, False), (4, 4, 4, True), (5, 4, 4, False),
    ])
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or -1, r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, near(a)), (2, " ".join(b)), (7, "one row twice"), (4, None), (-1, " ".join(a)), (-1, " ".join(a))], key=repr
    )


def test_stages_on_shared_and_missing_ids_and_empty_tables(spark):
    item = common.table(spark, FOLDER, "benchmark").first()["text"]
    leak = " ".join(words(3)) + " " + item
    rows = [(1, leak), (1, " ".join(words(4))), (None, leak), (None, " ".join(words(5))), (2, None), (3, ""), (4, leak), (4, leak)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).withColumn("_text_key", F.lit("x"))
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in kept.collect()) == sorted(
        [(1, len(rows[1][1])), (-1, len(rows[3][1])), (2, 0), (3, 0)]
    )
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name


def test_fingerprints_over_thousands_of_ranges(spark):
    """A plan that grew with the ranges would not even be built."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    few = {tuple(r) for r in fingerprint.compare_with_next(docs).collect()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5000")
        plan = fingerprint.compare_with_next(docs)
        assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 200_000
        spark.conf.set("spark.sql.shuffle.partitions", "600")
        assert {tuple(r) for r in fingerprint.compare_with_next(docs).collect()} == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
