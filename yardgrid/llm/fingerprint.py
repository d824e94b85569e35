"""Homomorphic multiset fingerprints of documents.

A text is a multiset of passages: its lines, cut further at sentence ends and, where a sentence is
long, after every eight words. Each passage hashes to a vector of +1 and -1 in 256 lanes and the
fingerprint is the sum of the vectors modulo 2^16 in every lane. The sum does not depend on the
order of the passages, a passage is inserted or deleted by one addition or subtraction, and the
fingerprints of parts add up to the fingerprint of the whole. Passages shared by two texts add up in
the inner product of their sums, so the normalised product estimates the shared part
(standard error about 1/16). Likeness assumes fewer than 2^15 copies of one passage in a text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardgrid.llm.common import value_udf
from yardgrid.session import fan_out

LANES = 256
WORDS = 8

_PIECE = re.compile(r"[^\n.!?]*[\n.!?]+|[^\n.!?]+")
_GROUP = re.compile(r"(?:\S+\s*){1,%d}" % WORDS)
# A sentence shorter than this has few words and is one passage.
_SHORT = 4 * WORDS


def passages(text: str) -> list[str]:
    """The passages of a text, without surrounding white space; none for a blank text."""
    out = []
    for piece in _PIECE.findall(text):
        piece = piece.strip()
        if len(piece) <= _SHORT:
            if piece:
                out.append(piece)
        else:
            out += [g.rstrip() for g in _GROUP.findall(piece)]
    return out


def vector(parts: Iterable[str]) -> np.ndarray:
    """The sum of the hashed vectors of some passages, modulo 2^16 in every lane."""
    digests = [hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=LANES // 8).digest() for p in parts]
    total = np.zeros(LANES, np.int64)
    for at in range(0, len(digests), 4096):  # long texts block by block
        block = digests[at : at + 4096]
        rows = np.frombuffer(b"".join(block), np.uint8).reshape(len(block), -1)
        total += 2 * np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64) - len(block)
    return total.astype(np.uint16)


def insert(total: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The fingerprint after passages were added."""
    return (total + part).astype(np.uint16)


def delete(total: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The fingerprint after passages were taken away."""
    return (total - part).astype(np.uint16)


def encoded(total: np.ndarray) -> str:
    """A vector as text (base64 of little-endian lanes)."""
    return base64.b64encode(total.astype("<u2").tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    """The vector of a fingerprint text."""
    return np.frombuffer(base64.b64decode(text), "<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: estimated shared part of two multisets; 1 for two empty ones."""
    x, y = a.astype(np.int16).astype(np.float64), b.astype(np.int16).astype(np.float64)
    size = x @ x + y @ y
    return float(min(1.0, max(0.0, 2 * (x @ y) / size))) if size else 1.0


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of its whole texts; null counts as the empty text."""
    make = value_udf("string", lambda: lambda t: encoded(vector(passages(t))))
    return df.withColumn(out, make(F.coalesce(F.col(text), F.lit(""))))


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket in order, closed by a copy of the row that follows the bucket."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    before = None
    for batch in batches:
        out = []
        for copy, key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            now = (key, text, vector(passages(text)))
            if before is not None:
                changed = edit(before[1], text)
                after = vector(passages(changed))
                out.append((
                    before[0], len(before[1]),
                    hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                    encoded(before[2]), encoded(after),
                    likeness(before[2], after), likeness(before[2], now[2]),
                ))
            before = None if copy else now
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = zip(*out, strict=True) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _longs(values: list[int | None]) -> Column:
    """A literal array, given as one text however long it is."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against its edited form and against the next text by descending key.

    Rows are dealt out by ranges of the key, so texts move once and every range is streamed in
    order. Only the first row of a range is needed elsewhere: it is sent to the range before as
    well (the first of all to the last range, which closes the circle). Null texts are empty, null
    keys come last, equal keys are ordered by text; an empty table gives an empty result and a
    single row follows itself.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.coalesce(F.col("key"), F.lit(-(2**63)))
    parts = fan_out(spark)
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx(order, shares, 10_000)).first()[0] if shares else None
    bounds = _longs(sorted(set(cuts or []), reverse=True))
    ranged = rows.withColumn("range", F.size(F.filter(bounds, lambda c: order <= c)))
    # One row for each range: at most as many as there are shuffle partitions. A row that opens its
    # range also goes to the range before; both are looked up by the number of the range.
    firsts = sorted(ranged.groupBy("range").agg(F.max(order)).collect())
    opening: list[int | None] = [None] * (len(set(cuts or [])) + 1)
    before = list(opening)
    for i, (part, first) in enumerate(firsts):
        opening[part], before[part] = first, firsts[i - 1][0]
    target = F.when(order == F.get(_longs(opening), "range"), F.get(_longs(before), "range").cast("int"))
    copies = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("copy")))
    doubled = F.array(
        F.struct(F.col("range").alias("range"), F.lit(False).alias("copy")),
        F.struct(target.alias("range"), F.lit(True).alias("copy")),
    )
    dealt = ranged.select(
        F.explode(F.when(target.isNotNull(), doubled).otherwise(copies)).alias("to"), "key", "text"
    )
    streams = (
        dealt.select("to.range", "to.copy", "key", "text")
        .repartition(parts, "range")
        .sortWithinPartitions("range", "copy", F.col("key").desc_nulls_last(), F.col("text").desc())
        .select("copy", "key", "text")
    )
    return streams.mapInArrow(
        _compare,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double",
    )
