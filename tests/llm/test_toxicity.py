"""Training of the toxicity network: every labelled row counts, however many and however long."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from yardgrid.llm import toxicity


def table(spark, n, long=40):
    """Documents and labels; one in eight is toxic, and a few of each kind are very long."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 600, 9_000 if i < long and i % 2 else 12)]
        if bad:
            words[int(rng.integers(0, len(words)))] = "vile"
        docs.append((i, " ".join(words), "en" if i % 2 else None))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(
        labels, "doc_id bigint, toxic int"
    )


def test_all_labelled_rows_train(spark):
    docs, labels = table(spark, 7_300)  # more than 3,000 of one label, and texts beyond 20,000 characters
    extra = spark.createDataFrame([(1, 5), (2, None)], "doc_id bigint, toxic int")  # neither 0 nor 1
    rows = toxicity.examples(docs, labels.union(extra), F.col("doc_id") % 10 != 9, rows=1_000)
    assert rows.count() == 6_570 and rows.select("replica").distinct().count() == 7
    assert rows.filter(F.length("words") >= 4 * 9_000).count() > 10
    net = toxicity.train(rows)
    seen = toxicity.score_toxicity(docs.join(labels, "doc_id"), net).collect()
    bad = np.array([r["score"] for r in seen if r["toxic"]])
    good = np.array([r["score"] for r in seen if not r["toxic"]])
    assert (bad > 0.5).mean() > 0.95 and (good < 0.5).mean() > 0.95
    limits = toxicity.thresholds(net, rows)
    assert set(limits) == {"", "en"} or set(limits) == {""}


def test_a_step_in_blocks_is_the_step_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    start = rng.normal(0, 0.3, (toxicity.BUCKETS + toxicity._DENSE, toxicity.DIMENSIONS)).astype(np.float32)
    row = rng.integers(0, toxicity.BUCKETS, (50, 2))
    once, blocks = toxicity.Network(start.copy()), toxicity.Network(start.copy())
    toxicity._step(once, row, 1, 0.1)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    toxicity._step(blocks, row, 1, 0.1)
    assert np.allclose(once.weights, blocks.weights, atol=1e-6) and not np.allclose(once.weights, start)


def test_one_label_only_answers_its_share(spark):
    docs, labels = table(spark, 20, long=0)
    for wanted in (labels.filter("toxic = 0"), labels.limit(0)):
        net = toxicity.train(toxicity.examples(docs, wanted, F.lit(True)))
        assert max(r["score"] for r in toxicity.score_toxicity(docs, net).collect()) < 0.01
        assert toxicity.decide(toxicity.score_toxicity(docs, net), {}).filter("toxic_by_lang = 1").count() == 0


def test_texts_travel_once_and_rows_repeat_as_in_a_join(spark):
    docs, labels = table(spark, 40, long=0)
    nothing = spark.createDataFrame([(None, "a b", "en"), (3, None, None), (99, "c", "en")], docs.schema)
    more = spark.createDataFrame([(3, 1), (None, 1)], labels.schema)
    docs, labels = docs.union(nothing), labels.union(more)
    found = toxicity.examples(docs, labels, F.coalesce(F.col("doc_id") != 5, F.lit(True)))
    wanted = docs.filter("doc_id <> 5").join(labels, "doc_id").select(
        "toxic", "lang", toxicity.packed_words("text").alias("words")
    )
    def rows(table):
        return sorted((r["toxic"], r["lang"] or "", bytes(r["words"])) for r in table.collect())

    assert rows(found.select("toxic", "lang", "words")) == rows(wanted) and found.count() == 42
