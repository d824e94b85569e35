"""The prefix trie against a trie built in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.comparison import connect, difference
from yardgrid.llm import prefix_trie
from yardgrid.llm.oracles import ORACLES
from yardgrid.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows, again):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(turns)] for c, turns in said.items()}
    if again:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in said}
        first = {c: c - int(abs(c) % 5) * (1 if c >= 0 else -1) for c in said}
        said = {c: said.get(first[c], [])[: h[c]] + turns[h[c] :] for c, turns in said.items()}
    members = defaultdict(list)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(said[c]) == len(node)).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


def rows():
    """Shared beginnings, copies, nulls, equal rows, negative ids, a silent rebuilt conversation."""
    rng = random.Random(11)
    out = []
    for c in [*range(-7, 120), 10**15, 10**15 + 1]:
        for turn in range(rng.randrange(0, 6)):
            text = rng.choice(["a", "b", "é", "", None]) if rng.random() < 0.8 else f"own {c}"
            out.append((c, turn if turn else None, rng.choice(["user", "user", None]), text))
    out += [(c, k, "user", f"copied {k}") for c in range(200, 260) for k in range(3)]
    out += [(300, 1, "user", "twice"), (300, 1, "user", "twice"), (None, 0, "user", "no conversation")]
    out += [(c, 0, "user", "one turn only") for c in range(400, 420)]
    return out


@pytest.mark.parametrize("again", [False, True])
@pytest.mark.parametrize("most", [prefix_trie.MOST_COUNTERS, 64])
def test_equals_a_plain_trie(spark, monkeypatch, again, most):
    """With the usual sketch, and with one so small that nearly all prefixes look shared."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 64 if most == 64 else prefix_trie.BLOCK)
    monkeypatch.setattr(prefix_trie, "counters", lambda n, most=most, real=prefix_trie.counters: real(n, most))
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 3)  # long lists of ids come in several pieces
    given = rows()
    docs = spark.createDataFrame(given, SCHEMA)
    found = prefix_trie.prefix_trie(docs, prefix_trie.rebuilt if again else prefix_trie.plain).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(plain_trie(given, again), key=repr)


def test_long_conversations_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 4)
    monkeypatch.setattr(prefix_trie, "SPAN_BITS", 2)
    given = [(c, k, "user", f"turn {k % 7}" if k < 20 + c else f"own {c}") for c in range(3) for k in range(40)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(given, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(plain_trie(given, False), key=repr)


def test_sketch_never_takes_a_shared_prefix_for_a_single_one(spark):
    given = [(c, k, "user", f"{c // 2 if k == 0 else c} {k}") for c in range(600) for k in range(3)]
    _, turns = prefix_trie.plain(prefix_trie.numbered_turns(spark.createDataFrame(given, SCHEMA)))
    paths = prefix_trie.prefixes(turns)
    width = prefix_trie.counters(paths.count())
    rows = prefix_trie.screened(paths, prefix_trie.sketch(paths, width), width).collect()
    assert all(r["shared"] for r in rows if r["depth"] == 1)
    assert sum(r["shared"] for r in rows if r["depth"] > 1) < 60  # two thirds are proved single, but for chance
    assert prefix_trie.counters(10**12) == prefix_trie.MOST_COUNTERS


def test_query_equals_sql(spark):
    ours = QUERIES["op13_prefix_trie"](spark, SMALL).toPandas()
    assert difference(ours, connect(SMALL).sql(ORACLES["op13_prefix_trie"]).df()) is None


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, 0, "user", "x"), (2, 0, "user", "x")], SCHEMA)
    assert prefix_trie.prefix_trie(docs.limit(0), prefix_trie.rebuilt).count() == 0
    extra = docs.withColumns({"chunk": F.lit(1), "pos": F.lit("x"), "n": F.lit(2), "depth": F.lit(0), "a": F.lit(0)})
    assert prefix_trie.prefix_trie(extra).exceptAll(prefix_trie.prefix_trie(docs)).count() == 0
