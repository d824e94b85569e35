"""The stages of the pipeline on documents whose fate is known."""

from __future__ import annotations

import random

import tiktoken
import public_tokenizers

import corpus_pipeline
from yardgrid.llm import bpe, common, secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_duplicates", "decontamination", "secrets", "byte_bpe",
    ]
    stages = dict(corpus_pipeline.STAGES)
    given = common.documents(spark, FOLDER)
    item = common.table(spark, FOLDER, "benchmark").first()["text"]
    words = given.filter("n_chars > 3000 and lang = 'en'").first()["text"].split()
    rng = random.Random(1)
    rng.shuffle(words)
    fresh = " ".join(words[:200])
    near = " ".join(words[:100] + ["changed"] + words[101:200])
    leak = " ".join(words[200:260]) + " " + item + " " + " ".join(words[260:300])
    secret = " ".join(words[300:400]) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'
    planted = [(-5, fresh), (-4, near), (-3, leak), (-2, secret), (-1, "12 34 !!")]
    rows = [(d, t, "en", "s", len(t)) for d, t in planted]
    docs = given.union(spark.createDataFrame(rows, given.schema))

    one = stages["language"](spark, docs, FOLDER)
    ids = {r["doc_id"] for r in one.select("doc_id").collect()}
    assert one.columns == docs.columns and {-5, -4, -3, -2} <= ids and -1 not in ids
    two = stages["near_duplicates"](spark, docs, FOLDER)
    ids = {r["doc_id"] for r in two.select("doc_id").collect()}
    assert two.columns == docs.columns and -5 in ids and -4 not in ids and {-3, -2, -1} <= ids
    three = stages["decontamination"](spark, docs, FOLDER)
    ids = {r["doc_id"] for r in three.select("doc_id").collect()}
    assert three.columns == docs.columns and -3 not in ids and {-5, -4, -2, -1} <= ids
    four = stages["secrets"](spark, docs, FOLDER)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in four.collect()}
    assert four.columns == docs.columns and len(texts) == docs.count()
    for row in docs.collect():
        assert texts[row["doc_id"]][0] == secrets.redacted(row["text"], secrets.spans_of(row["text"]))
        assert texts[row["doc_id"]][1] == len(texts[row["doc_id"]][0])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    exact = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={}
    )
    five = {r["doc_id"]: list(r["ids"]) for r in stages["byte_bpe"](spark, docs, FOLDER).collect()}
    assert five == {r["doc_id"]: exact.encode_ordinary(r["text"]) for r in docs.collect()}


def test_run_applies_all_stages(spark):
    result = corpus_pipeline.run(spark, FOLDER)
    docs = common.documents(spark, FOLDER)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert sorted(r["doc_id"] for r in result.collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
