"""Source divergence against a dense computation in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.comparison import connect, difference
from yardgrid.llm import common, divergence
from yardgrid.llm.oracles import ORACLES
from yardgrid.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string"


def dense(rows, least):
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(words)
        documents[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        whole = Counter()
        for (other, _), c in counts.items():
            if other == lang:
                whole.update(c)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(whole)
        sources = sorted(s for other, s in groups if other == lang)
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, 50)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


def texts():
    rng = random.Random(3)
    rows = []
    for k in range(400):
        words = [rng.choice(["The", "the", "ÉTÉ", "été", "a-b", "x1y", "日本", "Zug"]) + rng.choice(["", "", "n", "e"]) for _ in range(rng.randrange(30))]
        rows.append((k, " ".join(words), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", "é", None])))
    rows += [(1000 + k, "one text in many rows The the", "en", f"s{k % 3}") for k in range(90)]
    rows += [(None, None, None, None), (None, None, "zz", "a"), (5, "", "zz", "b"), (5, "", "zz", "b"), (6, "lonely", "yy", "only")]
    return rows


@pytest.mark.parametrize("least", [1, 12, 30, 100_000])
def test_equals_the_dense_computation(spark, least):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = divergence.source_divergence(docs, least).collect()
    assert {tuple(r) for r in found} == dense(rows, least) and len(found) == len(dense(rows, least))


def test_query_equals_sql(spark):
    ours = QUERIES["op12_source_divergence"](spark, SMALL).toPandas()
    assert difference(ours, connect(SMALL).sql(ORACLES["op12_source_divergence"]).df()) is None
    assert set(ours.part) == {"pair", "term"}


def test_large_counts_stay_exact(spark):
    rows = [(9 * 10**15, 2 * 10**16, 50_000)]
    row = spark.createDataFrame(rows, "n bigint, words bigint, kept_terms bigint").select(
        divergence.share("n", "words", "kept_terms").alias("p")
    ).first()
    n, words, terms = rows[0]
    assert row["p"] == 1 + 10**9 * (n + 5) // (words + 5 * terms)


def test_each_distinct_text_is_split_once(spark):
    docs = spark.createDataFrame([(k, "some words", "en", f"s{k % 2}") for k in range(10)], SCHEMA)
    counts = {(r["source"], r["term"]): (r["n"], r["df"]) for r in divergence.term_counts(docs).collect()}
    assert counts == {(s, t): (5, 5) for s in ("s0", "s1") for t in ("some", "words")}


def test_empty_table_and_other_columns(spark):
    docs = common.documents(spark, SMALL)
    assert divergence.source_divergence(docs.limit(0)).count() == 0
    extra = docs.withColumns({"digest": F.lit(1), "copies": F.lit("x"), "term": F.lit(2), "n": F.lit(0), "z": F.lit(0)})
    assert divergence.source_divergence(extra).exceptAll(divergence.source_divergence(docs)).count() == 0


def test_terms_are_those_of_the_pattern():
    rng = random.Random(9)
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    alphabet = [chr(c) for c in range(0x180)] + ["日", "\U0001f600", " ", "\x85", "\xa0"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(60))
        wanted = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        assert [t.decode() for t in divergence.terms_of(text)] == wanted


def test_sums_of_a_task_come_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    docs = spark.createDataFrame(texts(), SCHEMA)
    assert {tuple(r) for r in divergence.source_divergence(docs, 12).collect()} == dense(texts(), 12)
