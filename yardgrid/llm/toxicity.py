"""Toxicity by a small convolutional network over hashed word embeddings.

The vector of a word is the sum of two rows of a table, hashed from the word and from its first
characters, so that unseen forms of a known stem have a meaning. Filters of widths one to three run over the word vectors,
each filter keeps its largest response in the whole text, and a logistic layer weighs them. All
labelled texts train the network: they are dealt into replicas of some thousand rows, in every round
each replica descends from the common weights over its rows, in a task, and the changes are averaged
weight by weight in Spark. Scores come from the text alone. The scale of the scores, and thresholds
for each language, are calibrated on all training rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from yardgrid.llm.common import value_udf
from yardgrid.session import fan_out, settle

BUCKETS = 1 << 16
DIMENSIONS = 8
STEM = 4
SHRINKAGE = 8.0
WIDTHS = (1, 2, 3)
FILTERS = 8
# Rows of a replica, about, and rounds over all rows.
REPLICA_ROWS = 4_096
EPOCHS = 3
THRESHOLD = 0.3
# Words remembered by a task, and words put through the network at once.
REMEMBERED, BLOCK = 400_000, 1 << 16

_WORD = re.compile(r"[^\W\d_]+")


class Buckets(dict):
    """The two rows of a word in one number; remembers words, and starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        rows = 0
        for part in (word, word[:STEM] + "-"):
            row = xxhash.xxh32_intdigest(part.encode("utf-8", "surrogatepass")) % BUCKETS
            rows = rows * BUCKETS + row
        self[word] = rows
        return rows


def word_rows(text: str, buckets: Buckets) -> np.ndarray:
    """The table rows of the words of a text, in order; shape (words, 2)."""
    both = np.fromiter(map(buckets.__getitem__, _WORD.findall(text.lower())), np.int64)
    return np.stack([both // BUCKETS, both % BUCKETS], axis=1)


# Rows of weights after those of the table: the filters of each width, their biases, the logistic layer and
# its bias. All have DIMENSIONS columns, which is also the number of filters of a width.
_DENSE = sum(w * DIMENSIONS for w in WIDTHS) + 2 * len(WIDTHS) + 1
assert FILTERS == DIMENSIONS


@dataclass
class Network:
    """All weights as one matrix; the parts below are views of it.

    ``filters[w]`` has the shape (w * DIMENSIONS, FILTERS).
    """

    weights: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self) -> None:
        self.table, at = self.weights[:BUCKETS], BUCKETS
        self.filters, self.biases = {}, {}
        for w in WIDTHS:
            self.filters[w] = self.weights[at : at + w * DIMENSIONS]
            at += w * DIMENSIONS
        for w in WIDTHS:
            self.biases[w] = self.weights[at]
            at += 1
        self.out = self.weights[at : at + len(WIDTHS)].reshape(-1)
        self.last = self.weights[at + len(WIDTHS)]

    def __reduce__(self) -> tuple:
        return Network, (self.weights, self.scale)

    @property
    def bias(self) -> float:
        return float(self.last[0])

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The largest response of every filter, over all positions of a text, at least 0.

        Long texts go block by block; blocks overlap so that no window is lost.
        """
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        last = max(WIDTHS) - 1
        for at in range(0, max(len(rows), 1), BLOCK):
            part = rows[max(0, at - last) : at + BLOCK]
            vectors = self.table[part[:, 0]] + self.table[part[:, 1]]
            for k, width in enumerate(WIDTHS):
                n = len(part) - width + 1
                if n < 1:
                    continue
                weights = self.filters[width]
                response = vectors[:n] @ weights[:DIMENSIONS]
                for j in range(1, width):
                    response += vectors[j : j + n] @ weights[j * DIMENSIONS : (j + 1) * DIMENSIONS]
                top = response.max(axis=0) + self.biases[width]
                span = slice(k * FILTERS, (k + 1) * FILTERS)
                np.maximum(best[span], top, out=best[span])
        return best

    def logit(self, rows: np.ndarray) -> float:
        return float(self.pooled(rows) @ self.out + self.bias)

    def score(self, rows: np.ndarray) -> float:
        a, b = self.scale
        return float(1.0 / (1.0 + np.exp(-np.clip(a * self.logit(rows) + b, -30, 30))))


_PACKED = BUCKETS  # both rows of a word in one unsigned number of 32 bits


def packed_words(text: str) -> Callable[..., Column]:
    """The table rows of the words of a text column, four bytes a word."""

    def make() -> Callable[[str], bytes]:
        buckets = Buckets()

        def pack(value: str) -> bytes:
            rows = word_rows(value, buckets)
            return (rows[:, 0] * _PACKED + rows[:, 1]).astype("<u4").tobytes()

        return pack

    return value_udf("binary", make)(F.coalesce(F.col(text), F.lit("")))


def _unpacked(words: bytes) -> np.ndarray:
    both = np.frombuffer(words, "<u4").astype(np.int64)
    return np.stack([both // _PACKED, both % _PACKED], axis=1)


def examples(df: DataFrame, labels: DataFrame, usable: Column, rows: int = REPLICA_ROWS) -> DataFrame:
    """replica, toxic, lang and packed words of every labelled text that is ``usable``, stored.

    Replicas have about ``rows`` rows, chosen by hashed ids, and lie in the order of these in a file.
    """
    wanted = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(usable)
    replicas = max(1, -(-wanted.count() // rows))
    # Texts and labels meet in the task that holds their replica, so texts travel once, whatever the size.
    both = df.select("doc_id", "text", "lang", F.lit(None).cast("int").alias("toxic"), F.lit(True).alias("_text")).filter(
        usable & F.col("doc_id").isNotNull()
    ).unionByName(wanted.withColumn("_text", F.lit(False)), allowMissingColumns=True)
    replica = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(replicas)).cast("int")
    placed = both.withColumn("replica", replica).repartition(fan_out(df.sparkSession), "replica")
    met = placed.withColumn("_labels", F.collect_list("toxic").over(Window.partitionBy("replica", "doc_id"))).filter("_text")
    found = met.select(
        "replica", "doc_id", F.explode("_labels").alias("toxic"), "lang", packed_words("text").alias("words")
    )
    order = ("replica", F.xxhash64("doc_id", F.lit(1)), "doc_id", "toxic", "words")
    return settle(found.sortWithinPartitions(*order).drop("doc_id"))


# Its name before it gave all labelled texts; callers still use it.
sample = examples


def _stored_examples(rows: DataFrame | Sequence[tuple[str, str | None, int]]) -> DataFrame:
    """Rows of :func:`examples` as they are, or a few given as (text, language, label)."""
    if isinstance(rows, DataFrame):
        return rows
    texts = SparkSession.active().createDataFrame(list(rows), "text string, lang string, toxic int")
    return settle(texts.select(F.lit(0).alias("replica"), "toxic", "lang", packed_words("text").alias("words")))


def train(rows: DataFrame | Sequence[tuple[str, str | None, int]], seed: int = 3) -> Network:
    """Fit the network to all rows of :func:`examples`, or a few given as (text, language, label);
    without both labels it answers the share of toxic examples."""
    rows = _stored_examples(rows)
    rng = np.random.default_rng(seed)
    net = Network(np.zeros((BUCKETS + _DENSE, DIMENSIONS), np.float32))
    net.table[:] = rng.normal(0, 0.1, net.table.shape)
    for w in WIDTHS:
        net.filters[w][:] = rng.normal(0, 0.5, net.filters[w].shape)
    net.out[:] = rng.normal(0.3, 0.1, net.out.shape)
    net.last[0] = -1.0
    found = dict(rows.groupBy("toxic").count().collect())
    counts = np.array([[found.get(0, 0)], [found.get(1, 0)]], np.float64)
    if not counts.all():
        share = float(counts[1, 0] / counts.sum()) if counts.any() else 0.0
        net.out[:] = 0
        net.last[0] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return net
    # The first dimension starts as the log-odds of a word in toxic against other texts.
    seen = np.zeros((2, BUCKETS))
    total = rows.select("toxic", "words").mapInArrow(_count_rows, "row int, clean bigint, toxic bigint")
    sums = total.groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen[:, sums["row"].to_numpy()] = sums["clean"].to_numpy(), sums["toxic"].to_numpy()
    rate = (seen + 0.5) / (counts + 1.0)
    total = seen.sum(axis=0)  # shrunk where a row was seen in few texts
    net.table[:, 0] = np.log(rate[1] / rate[0]) * total / (total + SHRINKAGE) / 2
    net.filters[1][0, :2] = 1.0
    columns = [f"d{i}" for i in range(DIMENSIONS)]
    for epoch in range(EPOCHS):
        changed = rows.select("replica", "toxic", "words").mapInArrow(
            partial(_descend, net, 0.05 / (1 + epoch)), "row int, " + ", ".join(f"{c} float" for c in columns)
        )
        # At most one row for each row of the weights, whatever the number of replicas.
        mean = changed.groupBy("row").agg(*[F.avg(c).alias(c) for c in columns]).toArrow()
        net.weights[mean["row"].to_numpy()] += np.stack([mean[c].to_numpy() for c in columns], axis=1).astype(np.float32)
    net.scale = _calibrate(logits(rows, net))
    return net


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each label a table row occurs."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for label, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            seen[label, np.unique(_unpacked(words))] += 1
    found = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(found, pa.int32()), pa.array(seen[0, found]), pa.array(seen[1, found])], ["row", "clean", "toxic"]
    )


def _descend(net: Network, rate: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stochastic gradient descent of each replica from the same weights; its changes, by row."""

    def changes() -> pa.RecordBatch:
        change = own.weights - net.weights
        moved = np.flatnonzero(change.any(axis=1))
        columns = [pa.array(moved, pa.int32()), *[pa.array(change[moved, i]) for i in range(DIMENSIONS)]]
        return pa.RecordBatch.from_arrays(columns, ["row", *[f"d{i}" for i in range(DIMENSIONS)]])

    current = None
    for batch in batches:
        for replica, label, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if replica != current:
                if current is not None:
                    yield changes()
                own, current = Network(net.weights.copy()), replica
            _step(own, _unpacked(words), label, rate)
    if current is not None:
        yield changes()


def _step(net: Network, row: np.ndarray, label: float, rate: float) -> None:
    """One whole text: responses, their places, and the gradient through the places only. Long
    texts go block by block."""
    pooled = np.zeros(len(net.out), np.float32)
    places = np.zeros(len(net.out), np.int64)
    for k, width in enumerate(WIDTHS):
        if len(row) < width:
            continue
        span, best = slice(k * FILTERS, (k + 1) * FILTERS), np.full(FILTERS, -np.inf, np.float32)
        weights = net.filters[width]
        for at in range(0, len(row) - width + 1, BLOCK):
            part = row[at : at + BLOCK + width - 1]
            vectors, n = net.table[part[:, 0]] + net.table[part[:, 1]], len(part) - width + 1
            response = vectors[:n] @ weights[:DIMENSIONS]
            for j in range(1, width):
                response += vectors[j : j + n] @ weights[j * DIMENSIONS : (j + 1) * DIMENSIONS]
            place = response.argmax(axis=0)
            top = response[place, np.arange(FILTERS)]
            places[span] = np.where(top > best, at + place, places[span])
            best = np.maximum(best, top)
        pooled[span] = best + net.biases[width]
    active = pooled > 0
    pooled = np.where(active, pooled, 0)
    z = float(np.clip(pooled @ net.out + net.bias, -30, 30))
    error = 1 / (1 + np.exp(-z)) - label
    if abs(error) < 1e-3:
        return
    steps = rate * np.where(active, error * net.out, 0).astype(np.float32)
    net.out -= rate * error * pooled
    net.last[0] -= rate * error
    for k, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            step = steps[k * FILTERS + f]
            if not step:
                continue
            place = places[k * FILTERS + f]
            both = row[place : place + width]
            around = (net.table[both[:, 0]] + net.table[both[:, 1]]).reshape(-1)
            change = (step * net.filters[width][:, f]).reshape(width, DIMENSIONS)
            net.filters[width][:, f] -= step * around
            net.biases[width][f] -= step
            for half in both.T:
                np.subtract.at(net.table, half, change)


def logits(rows: DataFrame, net: Network) -> DataFrame:
    """lang, toxic and logit of all rows of :func:`examples`, stored."""
    logit = value_udf("double", lambda: lambda words: net.logit(_unpacked(words)))
    return settle(rows.select("lang", "toxic", logit(F.col("words")).alias("logit")))


def _score(logit: Column, scale: tuple[float, float]) -> Column:
    a, b = scale
    return 1 / (1 + F.exp(-F.greatest(F.least(a * logit + b, F.lit(30.0)), F.lit(-30.0))))


def _calibrate(rows: DataFrame, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method with a little shrinkage; the sums of a
    step are taken over all rows, and the labels weigh alike."""
    counts = dict(rows.groupBy("toxic").count().collect())
    weight = F.when(F.col("toxic") == 1, 0.5 / max(counts.get(1, 0), 1)).otherwise(0.5 / max(counts.get(0, 0), 1))
    beta, z = np.array([1.0, 0.0]), F.col("logit")
    for _ in range(steps):
        p = _score(z, tuple(beta.tolist()))
        slope, curve = weight * (p - F.col("toxic")), weight * p * (1 - p)
        g0, g1, c0, c1, c2 = rows.agg(*map(F.sum, (slope * z, slope, curve * z * z, curve * z, curve))).first()
        gradient = np.array([g0, g1]) + 1e-3 * (beta - [1.0, 0.0])
        change = np.linalg.solve(np.array([[c0, c1], [c1, c2]]) + 1e-3 * np.eye(2), gradient)
        beta = beta - np.clip(change, -1, 1)
        if np.abs(change).max() < 1e-6:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def thresholds(
    net: Network, rows: DataFrame | Sequence[tuple[str, str | None, int]], least: int = 50
) -> dict[str, float]:
    """For each language with enough rows of :func:`examples`, the score that makes the fewest errors there.

    Errors of the two labels weigh alike. ``""`` has the threshold of all other languages.
    """
    cuts = np.linspace(0.05, 0.95, 19)
    scored = logits(_stored_examples(rows), net).withColumn("score", _score(F.col("logit"), net.scale))
    wrong = [F.count_if((F.col("score") >= float(c)) != (F.col("toxic") == 1)).alias(f"e{i}") for i, c in enumerate(cuts)]
    tallies = [F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"), *wrong]
    by_lang = scored.filter("lang is not null").groupBy("lang").agg(*tallies).filter(F.least("bad", "good") >= least)
    whole = scored.agg(*tallies).withColumn("lang", F.lit("")).filter("bad + good > 0")
    found = {}
    for row in [*whole.collect(), *by_lang.filter("lang <> ''").collect()]:
        errors = np.array([row[f"e{i}"] for i in range(len(cuts))])
        best = np.flatnonzero(errors == errors.min())
        found[row["lang"]] = float(cuts[best[len(best) // 2]])
    return found or {"": THRESHOLD}


def scorer(net: Network) -> Callable[[str], float]:
    """A function from a text to its score."""
    buckets = Buckets()
    return lambda text: net.score(word_rows(text, buckets))


def score_toxicity(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each whole text; null counts as the empty text."""
    score = value_udf("double", lambda: scorer(net))
    return df.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))


def decide(
    df: DataFrame, limits: dict[str, float], score: str = "score", lang: str = "lang",
    out: str = "toxic_by_lang",
) -> DataFrame:
    """``df`` with 1 where the score reaches the threshold of the row's language, else 0."""
    limit = F.lit(limits.get("", THRESHOLD))
    for name, value in sorted(limits.items()):
        if name:
            limit = F.when(F.col(lang) == name, F.lit(value)).otherwise(limit)
    return df.withColumn(out, (F.col(score) >= limit).cast("int"))
