"""The quality cascade against plain counting, and its order."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.comparison import connect, difference
from yardgrid.llm import common, quality
from yardgrid.llm.oracles import ORACLES
from yardgrid.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    seen = {}
    for k in range(len(words) - 4):
        seen.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + step for places in seen.values() if len(places) > 1 for k in places for step in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "a a a a a", "a a a a a a a", "x\n\nx\n x\nx", "| # $ & < > % *", "é é \U0001f600 日本"]
    for _ in range(150):
        words = [rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(40))]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t", " \r\n"]) for w in words))
    return out


def test_counts_are_those_of_plain_counting(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id bigint, text string")
    rows = quality.apply_rules(docs, quality.RULES, report=COUNTS).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert tuple(row["quality"][c] for c in COUNTS) == plain_counts(row["text"]), row["text"]


def test_query_equals_sql(spark):
    ours = QUERIES["op11_quality_cascade"](spark, SMALL).toPandas()
    assert difference(ours, connect(SMALL).sql(ORACLES["op11_quality_cascade"]).df()) is None
    assert 0 < ours.kept.sum() < len(ours)


def test_order_changes_the_rule_named_but_not_the_verdict(spark):
    docs = common.documents(spark, SMALL)
    orders = [quality.RULES, quality.RULES[::-1], quality.estimate_order(docs)]
    verdicts = [
        {r["doc_id"]: r["quality"]["kept"] for r in quality.apply_rules(docs, order).collect()} for order in orders
    ]
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_rules_are_ordered_by_rejections_for_their_work(spark):
    rows = [(k, "word " * 12 if k % 2 else "many different words stand here " + " ".join(f"w{k}{j}" for j in range(9))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    costly = quality.Rule("costly", ("n_repeat_words",), "n_repeat_words > 0")  # rejects half
    cheap = quality.Rule("cheap", ("n_symbols",), "n_symbols > 99")  # rejects none
    twice = quality.Rule("twice", ("n_words", "n_repeat_words"), "n_repeat_words > 5")  # what `costly` rejects too
    few = quality.Rule("few", ("n_words",), "n_words < 14")  # the same half for less work
    order = quality.estimate_order(docs, rules=[cheap, costly, twice, few])
    assert [r.name for r in order][0] == "few" and len(order) == 4
    assert quality.estimate_order(docs, rules=[cheap, costly, twice])[0] is costly
    # A reported feature is computed anyway and costs its rule nothing.
    assert quality.estimate_order(docs, rules=[few, costly], report=("n_repeat_words",))[0] is costly


def test_rejected_rows_compute_no_later_feature(spark, monkeypatch):
    failing = quality.Feature((), lambda: F.raise_error(F.lit("computed")).cast("bigint"), "1")
    monkeypatch.setitem(quality.FEATURES, "never", failing)
    docs = spark.createDataFrame([(1, "too short")], "doc_id bigint, text string")
    order = [quality.RULES[0], quality.Rule("late", ("never",), "never > 0")]
    assert quality.apply_rules(docs, order).first()["quality"]["failed_rule"] == "few_words"
    with pytest.raises(Exception, match="computed"):
        quality.apply_rules(docs, order[::-1]).collect()


def test_clashing_columns_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, 3, "x"), (1, None, 3, "x"), (None, "words " * 3, None, None)],
        "alive bigint, text string, n_words int, failed_rule string",
    ).withColumns({"row": F.lit("r"), "quality": F.lit("old")})
    out = quality.apply_rules(docs, quality.RULES, report=("n_words",))
    assert set(out.columns) == set(docs.columns)
    rows = out.collect()
    assert [r["quality"]["n_words"] for r in rows] == [0, 0, 3] and rows[0]["n_words"] == 3 and rows[0]["failed_rule"] == "x"
    assert out.filter("quality.kept and n_words = 3").count() == 0
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == 0
    assert quality.apply_rules(docs.limit(0), quality.estimate_order(docs.limit(0))).count() == 0


def test_main_path_is_native(spark):
    plan = QUERIES["op11_quality_cascade"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
