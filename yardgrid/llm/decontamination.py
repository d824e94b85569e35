"""Benchmark passages in documents, by latent semantic retrieval and a check of the words.

Passages are windows of words. Terms are weighted by their inverse document frequency over all
documents. A randomised singular value decomposition of the TF-IDF passages of the benchmark gives
the latent space; its products are summed over Spark tasks. Every window of every document is
compared with the benchmark items by cosine, relative to what a window inside the item could reach.
The threshold follows from the share of the item that must occur and from how much of it some window
has at the worst offset; the latent space loses more the more items there are, so it gives the cosine
of the candidates and excludes none. Candidates are verified by the longest common subsequence of words, which survives
inserted, dropped and replaced words. A weaker match must also have the item's answer: its last
sentences, as many as have five words together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 12
WIDTH = 2 * STEP
RANK, OVERSAMPLING, ROUNDS = 128, 16, 2
ITEMS = 1_000  # benchmark items searched in one pass over the documents
SLACK = 0.6  # of the candidates' threshold, for heavy words that are lost and for inserted ones
COMMON, ANSWER = 0.7, 0.6  # shares of an item and of its answer that must occur in order
SURE = 0.8  # share of an item that is enough without its answer
ANSWER_WORDS = 5  # an answer has as many words at least, if its item has
SEGMENT = STEP * 8_000  # words projected at once

_GAP = re.compile(r"[^\w\s]+|_+")
_SENTENCE = re.compile(r"[.!?]+\s+")


def words_of(text: str) -> list[str]:
    """The words of a text: letters and digits in lower case, everything else is a gap."""
    # The two usual marks go first: plain replacement is much faster than the pattern.
    return _GAP.sub(" ", text.lower().replace(".", " ").replace(",", " ")).split()


def document_frequencies(df: DataFrame, words: list[str], text: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows each of the words occurs, and the number of rows."""
    wanted = frozenset(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = Counter(), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                texts += 1
                if value:
                    seen.update(wanted.intersection(words_of(value)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([*seen, None], pa.string()), pa.array([*seen.values(), texts], pa.int64())], names=["word", "n"]
        )

    rows = df.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in rows.collect()}  # one row per benchmark word
    return np.array([found.get(w, 0) for w in words], np.float64), found.get(None, 0)


@dataclass
class Item:
    """A benchmark text with the bit masks of its words, for common subsequences."""

    key: int
    words: list[str]
    answer: list[str]

    @classmethod
    def read(cls, key: int, text: str) -> Item:
        sentences = [s for s in map(words_of, _SENTENCE.split(text)) if s]
        words = [w for s in sentences for w in s]
        answer: list[str] = []
        while sentences and len(answer) < ANSWER_WORDS:
            answer = sentences.pop() + answer
        return cls(key, words, answer)

    def masks(self, words: list[str]) -> dict[str, int]:
        found: dict[str, int] = {}
        for i, word in enumerate(words):
            found[word] = found.get(word, 0) | 1 << i
        return found


def common_subsequence(masks: dict[str, int], length: int, region: list[str]) -> int:
    """Length of the longest common subsequence, all columns of a row at once in one number."""
    everything = (1 << length) - 1
    state = everything
    for word in region:
        hit = state & masks.get(word, 0)
        state = ((state + hit) | (state - hit)) & everything
    return length - state.bit_count()


def _windows(n: int) -> Iterator[tuple[int, int]]:
    """The windows over n words: ``WIDTH`` words at every ``STEP``."""
    for start in range(0, max(1, n - WIDTH + STEP), STEP):
        yield start, min(start + WIDTH, n)


def randomised_svd(passages: DataFrame, features: int, rank: int, parts: int = 8) -> np.ndarray:
    """The leading right singular vectors (features x rank) of sparse rows (``terms``, ``weights``).

    The rows stay in Spark: each task multiplies its own with the current basis and back, and one
    matrix of the size of the basis per task is added up.
    """
    wide = min(rank + OVERSAMPLING, features)
    rows = passages.repartition(parts).cache()

    def product(basis: np.ndarray) -> np.ndarray:
        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((features, basis.shape[1]))
            for batch in batches:
                for terms, weights in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    w = np.array(weights)
                    np.add.at(total, terms, np.outer(w, w @ basis[terms]))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

        found = rows.mapInArrow(multiply, "m binary").toArrow()["m"]
        return sum((np.frombuffer(m.as_py()).reshape(features, -1) for m in found), np.zeros_like(basis))

    basis = np.linalg.qr(np.random.default_rng(2).normal(size=(features, wide)))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(product(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    rows.unpersist()
    return basis @ turn[:, np.argsort(values)[::-1][:rank]]


@dataclass
class Index:
    """What a task needs to search for some items."""

    items: list[Item]
    places: dict[str, int]  # row of an item word in the arrays
    squares: np.ndarray  # squared weight of a word; of other words at the end
    loads: np.ndarray  # weight times latent coordinates of a word
    queries: np.ndarray  # latent items, scaled so that 1 is as high as the item can get


def build_index(docs: DataFrame, items: list[tuple[int, str]]) -> Index:
    """Latent space and queries of at most ``ITEMS`` items.

    A word weighs log(1 + rows / rows with it) over all rows of ``docs``. Words outside the items
    only lengthen a window; they count with the mean weight of the items' words.
    """
    read = [item for item in (Item.read(k, t) for k, t in items) if item.words]
    vocabulary = sorted({w for item in read for w in item.words})
    if not vocabulary:
        return Index([], {}, np.zeros(1), np.zeros((0, 1), np.float32), np.zeros((1, 0), np.float32))
    places = {w: i for i, w in enumerate(vocabulary)}
    frequencies, rows_in_all = document_frequencies(docs, vocabulary)
    weight = np.log1p(max(rows_in_all, 1) / np.maximum(frequencies, 1)).astype(np.float32)

    def sparse(words: list[str]) -> tuple[list[int], np.ndarray]:
        rows, times = np.unique(np.array([places[w] for w in words], np.int64), return_counts=True)
        return rows.tolist(), (times * weight[rows]).astype(np.float64)

    passages = []
    for item in read:
        for a, b in _windows(len(item.words)):
            rows, values = sparse(item.words[a:b])
            passages.append((rows, (values / np.linalg.norm(values)).tolist()))
    table = docs.sparkSession.createDataFrame(passages, "terms array<int>, weights array<double>")
    loads = (weight[:, None] * randomised_svd(table, len(vocabulary), RANK)).astype(np.float32)
    kept, queries = [], []
    for item in read:
        rows, values = sparse(item.words)
        norm = float(np.linalg.norm(values))
        latent = sum((loads[r] * (v / weight[r]) for r, v in zip(rows, values, strict=True)), np.zeros(loads.shape[1]))
        if not norm:
            continue
        n = len(item.words)
        reach = math.sqrt(min(n, WIDTH) / max(n, WIDTH)) * float(latent @ latent) / norm
        kept.append(item)
        queries.append(latent / reach if reach else latent)
    width = loads.shape[1]
    stacked = np.array(queries, np.float32).T if queries else np.zeros((width, 0), np.float32)
    squares = np.append(weight.astype(np.float64) ** 2, float(weight.mean()) ** 2)
    return Index(kept, places, squares, loads, np.ascontiguousarray(stacked))


Match = tuple[int, int, float, float, int, int]


def searcher(index: Index) -> Callable[[list[str]], list[list[tuple]]]:
    """A function from texts to their matches (item, common, answer, cosine, start, end)."""
    places, loads, queries, square = index.places, index.loads, index.queries, index.squares
    other = len(places)
    masks = [(i.masks(i.words), i.masks(i.answer)) for i in index.items]
    if not index.items:
        return lambda texts: [[] for _ in texts]
    known = np.zeros((len(index.items), other + 1), bool)  # which words an item has
    for number, item in enumerate(index.items):
        known[number, [places[w] for w in item.words]] = True
    item_norms = np.sqrt(known @ square)
    lengths = np.array([len(i.words) for i in index.items], np.float64)
    reach = np.sqrt(np.minimum(lengths, WIDTH) / np.maximum(lengths, WIDTH)) * item_norms
    overlap = np.minimum(np.minimum(lengths, WIDTH), (lengths + STEP) // 2)  # with some window at any offset
    least = (SLACK * COMMON * overlap / np.minimum(lengths, WIDTH) * reach).astype(np.float32)
    shares = np.ascontiguousarray((known[:, :other] * square[:other]).T, np.float32)

    def candidates(segments: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(segment, window, item, cosine) of all windows that may be part of an item."""
        sizes = np.array([len(s) for s in segments])
        blocks = -(-sizes // STEP)
        offset = np.concatenate([[0], np.cumsum(blocks)])
        code = np.concatenate(segments)
        at = np.concatenate([o + np.arange(n) // STEP for o, n in zip(offset[:-1], sizes, strict=True)])
        active = np.flatnonzero(code < other)
        starts = np.concatenate([
            o + np.arange(max(1, b - 1)) for o, b in zip(offset[:-1], blocks, strict=True)
        ])
        alone = np.repeat(blocks == 1, np.maximum(1, blocks - 1))
        second = np.where(alone, offset[-1], starts + 1)  # an empty block at the end
        energy = np.append(np.bincount(at, square[code], minlength=offset[-1]), 0.0)
        shared = np.append(np.bincount(at[active], square[code[active]], minlength=offset[-1]), 0.0)
        norms = np.sqrt(energy[starts] + energy[second])
        # No item can have more in common with a window than all items' words in it weigh.
        hopeful = shared[starts] + shared[second] > norms * least.min()
        starts, second, norms = starts[hopeful], second[hopeful], norms[hopeful]

        def summed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The sums of the rows of the words in both blocks of the windows."""
            used = np.zeros(offset[-1] + 1, bool)
            used[starts] = used[second] = True
            inside = active[used[at[active]]]
            place = np.cumsum(used) - 1
            total = np.zeros((int(used.sum()), rows.shape[1]), np.float32)
            if len(inside):
                full, first = np.unique(at[inside], return_index=True)
                total[place[full]] = np.add.reduceat(rows[code[inside]], first, axis=0)
            return total[place[starts]] + total[place[second]]

        window, item = np.nonzero(summed(shares) > norms[:, None] * least)
        hit, window = np.unique(window, return_inverse=True)
        starts, second, norms = starts[hit], second[hit], norms[hit]
        found = summed(loads) @ queries
        segment = np.searchsorted(offset, starts[window], side="right") - 1
        for s, w, i, x in zip(
            segment.tolist(), (starts[window] - offset[segment]).tolist(), item.tolist(),
            (found[window, item] / np.maximum(norms[window], 1e-9)).tolist(), strict=True,
        ):
            yield s, w, i, x

    def verify(words: list[str], start: int, i: int) -> tuple[float, float, int, int] | None:
        """Common shares of item and answer around a window, and the words looked at."""
        item, n = index.items[i], len(index.items[i].words)
        low, high = max(0, start - n), min(len(words), start + WIDTH + n)
        region = words[low:high]
        inside = set(region)
        if sum(w in inside for w in item.words) < COMMON * n:
            return None
        common = common_subsequence(masks[i][0], n, region) / n
        if common < COMMON:
            return None
        answer = common_subsequence(masks[i][1], len(item.answer), region) / len(item.answer)
        return (common, answer, low, high) if common >= SURE or answer >= ANSWER else None

    def search(texts: list[str]) -> list[list[tuple]]:
        out: list[dict[int, tuple]] = [{} for _ in texts]
        pending: list[tuple[int, int, np.ndarray]] = []

        def flush() -> None:
            found: dict[tuple[int, int], list] = {}
            for s, window, i, cosine in candidates([p[2] for p in pending]):
                found.setdefault((pending[s][0], i), []).append((-cosine, pending[s][1] + window * STEP))
            plain: dict[int, list[str]] = {}
            for (t, i), windows in found.items():
                if t not in plain:
                    plain[t] = words_of(texts[t])
                for cosine, start in sorted(windows):
                    best = out[t].get(i)
                    if best is not None and best[1] == 1.0:
                        break
                    checked = verify(plain[t], start, i)
                    if checked and (best is None or checked[0] > best[1]):
                        common, answer, low, high = checked
                        out[t][i] = (index.items[i].key, common, answer, -cosine, low, high)
            pending.clear()

        total = 0
        for t, text in enumerate(texts):
            code = np.fromiter(map(places.get, words_of(text), repeat(other)), np.int64)
            for a in range(0, len(code), SEGMENT):
                if a and len(code) - a <= STEP:
                    break  # the segment before reached the end
                pending.append((t, a, code[a : a + SEGMENT + STEP]))
                total += len(pending[-1][2])
                if total >= SEGMENT:
                    flush()
                    total = 0
        if pending:
            flush()
        return [sorted(m.values()) for m in out]

    return search


FIELDS = (
    "doc_id bigint, item_id bigint, common double, answer double, cosine double,"
    " from_word bigint, to_word bigint"
)


def contaminated(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row for each document and benchmark item found in it.

    Columns: the two keys, the shares of the item and of its answer that occur in order, the
    cosine relative to the best possible, and the range of words that was looked at. All items are
    searched, ``ITEMS`` at a time, in all documents. Null and empty texts match nothing; repeated
    rows are found each; an empty table on either side gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    queries = benchmark.filter(F.length(item_text) > 0).select(
        F.col(item_key).cast("bigint").alias("item_id"), F.col(item_text).alias("text")
    )
    result = spark.createDataFrame([], FIELDS)
    block: list[tuple[int, str]] = []
    for row in queries.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS:
            result, block = result.union(_search(docs, build_index(docs, block))), []
    return result.union(_search(docs, build_index(docs, block))) if block else result


def _search(docs: DataFrame, index: Index) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher(index)
        names = ["doc_id", "item_id", "common", "answer", "cosine", "from_word", "to_word"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            keys, texts = (c.to_pylist() for c in batch.columns)
            rows = [(k, *m) for k, found in zip(keys, search(texts), strict=True) for m in found]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names
            )

    return docs.mapInArrow(run, FIELDS)
