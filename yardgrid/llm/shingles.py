"""Weighted word shingles, shared by the operators that compare texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5
REMEMBERED = 800_000

# Document frequencies are kept by hashed shingle. A bucket holds on average (mean shingles of a
# text / BUCKETS) of all documents by chance, a share that does not depend on their number; it is
# taken off. Shingles in at most the share RARE of all documents have the full weight. Near copies
# count each other's shingles as frequent, so the weight of a frequent shingle stays near a rare one's.
BUCKETS = 1 << 17  # the upper 17 bits
RARE = 0.01
LEAST_WEIGHT = 0.8

_NOT_WORD = re.compile(r"[\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64 hashed bits of the letters and digits of a token, 0 if it has none.

    Remembers tokens, and starts anew when it is full.
    """

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        word = token if token.isalnum() else _NOT_WORD.sub("", token)
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) if word else 0
        self[token] = value
        return value


def _rolled(text: str, hashes: WordHashes) -> np.ndarray:
    """The hashed shingles of a text in order."""
    words = np.fromiter(map(hashes.__getitem__, text.lower().split()), np.uint64)
    words = words[words != 0]
    if not len(words):
        return words
    width = min(WORDS, len(words))
    rolled = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + words[k : len(words) - width + 1 + k]
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return rolled ^ (rolled >> np.uint64(29))


def shingles(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of a text in ascending order, and how often each occurs.

    Words stand between white space, in lower case and without punctuation. A text of fewer than ``WORDS`` words is one
    shingle; a text without words has none.
    """
    return np.unique(_rolled(text, hashes), return_counts=True)


def bucket(hashed: np.ndarray) -> np.ndarray:
    """The frequency bucket of hashed shingles."""
    return (hashed >> np.uint64(47)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and shingles per bucket in a task; bucket -1 counts the documents."""
    hashes, seen, texts = WordHashes(), np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            texts += 1
            if text:  # a bucket that occurs several times in a text is counted once
                seen[bucket(_rolled(text, hashes))] += 1
    full = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(full, -1), pa.int32()), pa.array(np.append(seen[full], texts), pa.int64())],
        names=["bucket", "n"],
    )


def shingle_weights(df: DataFrame, text: str = "text") -> np.ndarray:
    """The weight of each bucket, from the document frequencies over all rows.

    The result has ``BUCKETS`` entries however large the table is.
    """
    counted = df.select(text).mapInArrow(_count, "bucket int, n bigint")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    counts = np.zeros(BUCKETS + 1, np.float64)  # the number of documents comes last
    counts[np.array(rows["bucket"], np.int64)] = rows["n"]
    texts, seen = max(counts[-1], 1.0), counts[:-1]
    share = np.clip((seen - seen.mean()) / texts, RARE, 1.0)
    return np.maximum(np.log(share) / np.log(RARE), LEAST_WEIGHT).astype(np.float32)


def weighted(
    text: str, hashes: WordHashes, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles in ascending order and their TF-IDF weights."""
    keys, times = shingles(text, hashes)
    return keys, times.astype(np.float32) * weights[bucket(keys)]


def least_weighted(similarity: float) -> float:
    """The smallest weighted similarity of two texts that are this similar without weights."""
    return LEAST_WEIGHT * similarity / (LEAST_WEIGHT * similarity + 1 - similarity)


def likeness(
    a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: np.ndarray
) -> float:
    """The larger of the weighted Jaccard similarity and the one of the bare shingle counts."""
    bare = [(keys, w / weights[bucket(keys)]) for keys, w in (a, b)]
    return max(weighted_jaccard(a, b), weighted_jaccard(*bare))


def weighted_jaccard(
    a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]
) -> float:
    """Sum of the smaller over sum of the larger weights; 1 for two empty sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 1.0
