"""Every text operator on nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from yardgrid.llm import (
    bpe,
    common,
    decontamination,
    fingerprint,
    language,
    near_dedup,
    secrets,
    sharding,
    substrings,
    token_counts,
    toxicity,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "   \n\t ", "en", "s", 6),
    (4, "The same words in two rows of this small table.", "en", "s", 47),
    (5, "The same words in two rows of this small table.", "en", None, 47),
    (5, "The same words in two rows of this small table.", "en", None, 47),
    (6, "日本語のテキスト ☃ ééé \U0001f600", "xx", "s", 20),
    (7, "z" * 3000, None, "s", 3000),
    (8, LONG, "en", "s", len(LONG)),
    (None, "No id here, only words that stand alone.", "en", "s", 40),
]


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    # Columns that look like the operators' own.
    return (
        spark.createDataFrame(ROWS, SCHEMA)
        .withColumns({"_arc": F.lit(1), "shard": F.lit("x"), "_language": F.lit(2), "found": F.lit(3)})
        .withColumns({"digest": F.lit("d"), "bands": F.lit(0), "key": F.lit(9), "id": F.lit(7), "label": F.lit(5)})
    )


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, LONG[:200])], "item_id bigint, text string")


def test_language(docs):
    models = language.fit_dictionaries(docs, F.lit(True))
    rows = language.identify(docs, models).select("doc_id", "text", "language.*").collect()
    assert len(rows) == len(ROWS)
    for row in rows:
        blank = not any(c.isalpha() for c in row["text"] or "")
        assert (row["lang"] == language.UNDETERMINED) == blank
        assert 0 <= row["score"] <= 1 and (row["rejected"] or not blank)
    kept = language.keep_identified(docs, models)
    assert kept.columns == docs.columns
    assert language.identify(docs.limit(0), {}).count() == 0
    assert {r["lang"] for r in language.identify(docs, {}).select("language.lang").collect()} == {"und"}


def test_decontamination(spark, docs, items):
    rows = decontamination.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(8, 4)}
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(4, 1), (6, 0), (8, None), (None, 1)], "doc_id bigint, toxic int")
    net = toxicity.train(toxicity.sample(docs, labels, F.lit(True)))
    scores = [r["score"] for r in toxicity.score_toxicity(docs, net).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    lonely = toxicity.train([("only good words", "en", 0)])
    assert toxicity.scorer(lonely)("anything") < 0.01
    assert toxicity.thresholds(lonely, []) == {"": toxicity.THRESHOLD}
    assert toxicity.score_toxicity(docs.limit(0), net).count() == 0


def test_near_duplicates(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == len(ROWS) - 1  # the row without an id
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_secrets(docs):
    rows = secrets.find_secrets(docs, out="hits").collect()
    assert len(rows) == len(ROWS) and all(r["hits"]["spans"] == "" for r in rows)
    same = secrets.redact_secrets(docs)
    assert same.columns == docs.columns and same.exceptAll(docs).count() == 0
    assert secrets.find_secrets(docs.limit(0), out="hits").count() == 0


def test_fingerprints(docs):
    rows = fingerprint.compare_with_next(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert fingerprint.compare_with_next(docs.limit(0)).count() == 0
    alone = fingerprint.compare_with_next(docs.filter("doc_id = 4")).collect()
    assert [r["near_next"] for r in alone] == [1.0]
    assert fingerprint.fingerprint(docs).count() == len(ROWS)


def test_shards(docs):
    out = sharding.assign_shards(docs, "doc_id", 3)
    rows = out.collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(3)]
    assert sorted(counts) == [3, 3, 4]
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert set(docs.columns) <= set(out.columns)
    assert sharding.assign_shards(docs.limit(0), "doc_id", 3).count() == 0


def test_token_counts(docs):
    rows = token_counts.count_tokens(docs, PIECES).collect()
    assert len(rows) == len(ROWS)
    assert {r["n_tokens"] for r in rows if not r["text"]} == {0}
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_byte_bpe(docs):
    encoded = bpe.encode(docs, BPE, public_tokenizers.PATTERN).withColumn("back", bpe.decode(F.col("ids"), BPE))
    assert encoded.filter("back <> decoded").count() == 0
    rows = encoded.collect()
    assert sorted(bytes(r["back"]).decode() for r in rows) == sorted(t or "" for _, t, *_ in ROWS)
    assert bpe.encode(docs.limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def test_shared_passages(docs):
    passages = substrings.shared_passages(docs, shortest=30)
    rows = {(r["doc_id"], r["first_doc_id"], r["is_first"]) for r in passages.collect()}
    assert rows == {(4, 4, True), (5, 4, False)}
    cut = substrings.without_repeats(docs, passages)
    texts = {(r["doc_id"], r["text"]) for r in cut.collect()}
    assert (5, "") in texts and (1, None) in texts and (4, ROWS[3][1]) in texts
    assert substrings.shared_passages(docs.limit(0)).count() == 0
