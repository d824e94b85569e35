"""Passages shared by documents, found by content-defined chunks.

A gear hash rolls over the bytes of a text. A byte is a cut where the hash of the last 16 bytes is
small, the next byte begins a character and no other such byte is among the nine before it. The rule
looks at 25 bytes only, so an insertion moves no cut beyond its neighbourhood and a passage has the
same inner chunks wherever it stands. Chunks have 26 bytes on average, and no upper bound in
stretches that repeat one pattern.

Digests are counted over all documents. A run of neighbouring chunks that all occur in several
documents is a shared passage when it has at least ``shortest`` characters. It is given in parts: what
a document has first, and what an earlier one has. So no chunk is taken for a repeat where it is first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardgrid.llm.common import struct_udf, value_udf
from yardgrid.session import settle

WINDOW = 16
SPACING = 10
SHORTEST = 64
_GEAR = np.random.default_rng(10).integers(0, 1 << 16, 256, dtype=np.uint16)
_SMALL = np.uint16((1 << 16) // SPACING)


def cuts(data: bytes) -> np.ndarray:
    """Positions (bytes, ascending) before which a chunk ends inside ``data``."""
    raw = np.frombuffer(data, np.uint8)
    rolled = _GEAR[raw]
    width = 1
    while width < WINDOW:  # the hash of twice as many bytes from two neighbouring hashes
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint16(width)
        rolled, width = wider, 2 * width
    begins = (raw[1:] & 0xC0) != 0x80
    found = np.flatnonzero((rolled[:-1] < _SMALL) & begins) + 1
    near = np.diff(found, prepend=-SPACING) < SPACING
    return found[~near]


def chunks(text: str) -> tuple[list[int], list[int], list[int]]:
    """Digest, start and length of every chunk, in code points; together they are the text."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [], [], []
    edges = [0, *cuts(data).tolist(), len(data)]
    digests = [
        xxhash.xxh3_64_intdigest(data[a:b]) - (1 << 63) for a, b in zip(edges, edges[1:], strict=False)
    ]
    if len(text) != len(data):
        begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        edges = [0, *begins[np.array(edges[1:]) - 1].tolist()]
    return digests, edges[:-1], [b - a for a, b in zip(edges, edges[1:], strict=False)]


def runs(pieces: list[tuple[int, int, int]], shortest: int, document: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest first document) of the parts of runs of neighbouring (start, length, first).

    A run counts with its whole length. It is given in parts, so that no part mixes chunks whose
    first document is ``document`` with others. Shorter chunks of its own at the ends of a run,
    mostly a few characters around a passage, are no part of it.
    """
    found: list[list[list[int]]] = []
    for start, length, first in sorted(set(pieces)):
        if not found or found[-1][-1][1] != start:
            found.append([])
        run = found[-1]
        if run and (run[-1][2] == document) == (first == document):
            run[-1][1] = start + length
            run[-1][2] = min(run[-1][2], first)
        else:
            run.append([start, start + length, first])
    out: list[tuple[int, int, int]] = []
    for run in found:
        if run[-1][1] - run[0][0] < shortest:
            continue
        for k, (a, b, first) in enumerate(run):
            if first != document or b - a >= shortest or 0 < k < len(run) - 1:
                out.append((a, b, first))
    return out


def _run_maker(shortest: int) -> Callable[[], Callable[[dict], list]]:
    return lambda: lambda row: [
        x
        for run in runs([(r["start"], r["length"], r["first"]) for r in row["pieces"]], shortest, row["doc_id"])
        for x in run
    ]


def shared_passages(
    df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST
) -> DataFrame:
    """One row for each part of a shared passage in each document.

    Columns: ``doc_id``, ``start``, ``end`` (code points, end exclusive), ``first_doc_id`` (the
    smallest id that shares a chunk of it) and ``is_first``: whether no document with a smaller id
    has any chunk of it. Exact copies share their whole text.
    Null and empty texts have no chunks; repeats inside one document do not count; rows with a null
    key cannot be named and are not compared; rows with equal keys are one document.

    Chunks are pre-aggregated by digest before the shuffle and joined back, so a passage that a
    third of all documents share is a skewed join, which adaptive execution splits.
    """
    cut = struct_udf(
        {"digest": "array<bigint>", "start": "array<int>", "length": "array<int>"}, lambda: chunks
    )
    stored = settle(
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).cast("bigint").alias("doc_id"), cut(F.coalesce(F.col(text), F.lit(""))).alias("c"))
        .select("doc_id", "c.digest", "c.start", "c.length")
    )
    shared = (
        stored.select("doc_id", F.explode("digest").alias("digest"))
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("digest", "first")
    )
    pieces = (
        stored.select("doc_id", F.explode(F.arrays_zip("digest", "start", "length")).alias("c"))
        .select("doc_id", "c.digest", "c.start", "c.length")
        .join(shared, "digest")
    )
    make_runs = value_udf("array<bigint>", _run_maker(shortest))
    found = (
        pieces.groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "length", "first")).alias("pieces"))
        .select("doc_id", make_runs(F.struct("doc_id", "pieces")).alias("flat"))
    )
    third = F.expr(
        "transform(sequence(0, size(flat) - 1, 3), i ->"
        " struct(flat[i] as start, flat[i + 1] as end, flat[i + 2] as first_doc_id))"
    )
    return (
        found.filter(F.size("flat") > 0)
        .select("doc_id", F.explode(third).alias("r"))
        .select("doc_id", "r.*", (F.col("doc_id") == F.col("r.first_doc_id")).alias("is_first"))
    )


def without_repeats(
    df: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``df`` with shared passages cut out of every document but the first that has them.

    A document without such a passage keeps its text as it is; null stays null.
    """
    spans = (
        passages.filter("not is_first")
        .groupBy(F.col("doc_id").alias("_of"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    )
    n = F.length(text)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("_spans.end"))
    ends = F.concat(F.col("_spans.start"), F.array(n.cast("bigint")))
    parts = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda p: F.substring(F.col(text), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")),
    )
    kept = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.array_join(parts, ""))
    joined = df.join(spans, F.col(key) == F.col("_of"), "left")
    return joined.withColumn(text, kept).select(*[F.col(f"`{c}`") for c in df.columns])
