"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

Every text gives 12 bands of three samples. A sample is the shingle (and its quantised weight) that
wins improved consistent weighted sampling: two texts agree in it with the probability of their
weighted Jaccard similarity. Texts that agree in a band share a bucket.

Equal texts are collapsed first. Pairs of a bucket whose total weights or sketches are too far
apart are left out before any text is fetched; a sketch has four bits of each of the 36 samples. In
a bucket of few texts all other pairs are compared. In a larger one every member is compared with
two leaders; what is then not in the bucket's largest component is compared with the rest of the
bucket block by block, each task skipping pairs that are connected already. A pair is verified by
its weighted similarity or, because a large group makes its own shingles frequent, by the plain one
of its shingle counts. Classes are the connected components of the verified links; links that blocks
add are drawn between the components of the links with leaders, two components having one at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from yardgrid.llm.common import fresh, struct_udf, value_udf
from yardgrid.llm.components import components, relabelled
from yardgrid.llm.shingles import (
    WordHashes,
    least_weighted,
    likeness,
    shingle_weights,
    weighted,
    weighted_jaccard,  # noqa: F401
)
from yardgrid.session import settle

SIMILARITY = 0.8
BANDS, ROWS = 12, 3
LEAST_AGREEMENT = 19
BLOCK = 256  # members in a block of a large bucket
SMALL = 12  # members of a bucket whose pairs are all compared at once

_SAMPLES = BANDS * ROWS
_rng = np.random.default_rng(4)
# The variates of the sampling, looked up by 16 hashed bits of shingle and sample.
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_B = _rng.random(1 << 16, dtype=np.float32)
_AT_ONE = _LOG_C - _R * (1 - _B)  # the rank of a shingle of weight 1
_ODD = _rng.integers(0, 1 << 63, _SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x94D049BB133111EB)
_BLOCK = 4096
_ONES = 0x111111111111


def samples(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The hashed sample (shingle and quantised weight) of each hash function."""
    best = np.full(_SAMPLES, np.inf, np.float32)
    out = np.zeros(_SAMPLES, np.uint64)
    each = np.arange(_SAMPLES)
    for at in range(0, len(keys), _BLOCK):
        k, log_w = keys[at : at + _BLOCK], np.log(weights[at : at + _BLOCK])
        index = ((k[None, :] * _ODD[:, None]) >> np.uint64(48)).astype(np.intp)
        rank = _AT_ONE[index]
        other = np.flatnonzero(log_w)
        level = np.zeros(len(other), np.float32)
        if len(other):
            picked = index[:, other]
            r, b = _R[picked], _B[picked]
            level = np.floor(log_w[other] / r + b)
            rank[:, other] = _LOG_C[picked] - r * (level - b + 1)
        place = rank.argmin(axis=1)
        least = rank[each, place]
        levels = np.zeros(_SAMPLES, np.int64)
        if len(other):
            column = np.searchsorted(other, place)
            hit = (column < len(other)) & (other[np.minimum(column, len(other) - 1)] == place)
            levels[hit] = level[each[hit], column[hit]].astype(np.int64)
        sampled = (k[place] + levels.astype(np.uint64) * _MIX) * _MIX
        better = least < best
        best[better], out[better] = least[better], sampled[better]
    return out


FIELDS = {"bands": "array<bigint>", "sketch": "array<bigint>", "weight": "double"}


def signature(keys: np.ndarray, weights: np.ndarray) -> tuple[list[int], list[int], float]:
    """One signed 64-bit key per band, the sketch, and the total weight.

    A text without shingles has no bands. A number of the sketch has four bits of each of the
    twelve samples that stand in the same place of their bands.
    """
    if not len(keys):
        return [], [], 0.0
    drawn = samples(keys, weights).reshape(BANDS, ROWS)
    nibbles = ((drawn >> np.uint64(50)) & np.uint64(15)) << (4 * np.arange(BANDS, dtype=np.uint64))[:, None]
    sketch = np.bitwise_or.reduce(nibbles, axis=0).astype(np.int64).tolist()
    mixed = np.arange(BANDS, dtype=np.uint64) * _ODD[0]
    for row in range(ROWS):
        mixed = (mixed ^ drawn[:, row]) * _MIX
        mixed ^= mixed >> np.uint64(32)
    return mixed.astype(np.int64).tolist(), sketch, float(weights.sum())


def _signing(weights: np.ndarray) -> Callable[[], Callable[[str], tuple]]:
    def make() -> Callable[[str], tuple]:
        hashes = WordHashes()
        return lambda text: signature(*weighted(text, hashes, weights))

    return make


def _comparing(weights: np.ndarray) -> Callable[[], Callable[[dict], float]]:
    def make() -> Callable[[dict], float]:
        hashes = WordHashes()
        last: dict[str, tuple] = {}

        def compare(pair: dict) -> float:
            if last.get("text") != pair["x"]:  # pairs of one leader come together
                last.update(text=pair["x"], set=weighted(pair["x"], hashes, weights))
            return likeness(last["set"], weighted(pair["y"], hashes, weights), weights)

        return compare

    return make


@dataclass(frozen=True)
class Texts:
    """Where the text of a node is: ``names`` has (id, doc_id, digest) of one row for each different
    text, ``rows`` has (doc_id, digest, text) of the documents."""

    names: DataFrame
    rows: DataFrame

    def attach(self, df: DataFrame, node: str, out: str) -> DataFrame:
        """``df`` with the text of a node; only the nodes of ``df`` are named before texts move."""
        doc, digest = f"_{out}_doc", f"_{out}_digest"
        names = self.names.select(F.col("id").alias(node), F.col("doc_id").alias(doc), F.col("digest").alias(digest))
        rows = self.rows.select(F.col("doc_id").alias(doc), F.col("digest").alias(digest), F.col("text").alias(out))
        return df.join(names, node).join(rows, [doc, digest]).drop(doc, digest)


def _measure(pairs: DataFrame, texts: Texts, weights: np.ndarray) -> DataFrame:
    """The similarity of each pair (a, b)."""
    compare = value_udf("double", _comparing(weights))
    both = texts.attach(texts.attach(pairs, "b", "y"), "a", "x")
    return both.select("a", "b", compare(F.struct("x", "y")).alias("similarity"))


def _plausible(x: str, y: str, similarity: float) -> Column:
    """Whether two texts may be alike, by total weights and sketches (columns with two prefixes).

    Texts of the plain similarity 0.8 have a weighted one of at least 0.76. Then they agree in 27 of
    36 samples on average, with a standard deviation of 2.6; ``LEAST_AGREEMENT`` lies three of them
    below.
    """
    ones = F.lit(_ONES)
    differing = F.lit(0)
    for i in range(ROWS):
        z = F.get(f"{x}sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}sketch", F.lit(i)))
        z = z.bitwiseOR(F.shiftright(z, 1))
        z = z.bitwiseOR(F.shiftright(z, 2))
        differing = differing + F.bit_count(z.bitwiseAND(ones))
    agree = differing <= F.lit(_SAMPLES - LEAST_AGREEMENT)
    a, b = F.col(f"{x}weight"), F.col(f"{y}weight")
    return agree & (F.least(a, b) >= F.greatest(a, b) * (least_weighted(similarity) - 1e-6))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _large_buckets(
    members: DataFrame, labels: DataFrame, texts: Texts, weights: np.ndarray, similarity: float
) -> DataFrame:
    """Links (a, b) between the components that share a large bucket, by their labels, each once.

    ``labels`` has (node, label); members that it leaves out are components of their own.

    Members outside the largest component of a bucket (the rest) and those in it are dealt into
    blocks. A task gets two blocks with their texts: two of the rest, or one of the rest and one
    of the largest component. So the work follows the size of the rest.
    """
    placed = (
        members.join(labels.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("label", F.coalesce("label", "id"))
    )
    sizes = placed.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        sizes.groupBy("band", "key")
        .agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
        .select("band", "key", F.col("top.label").alias("main"), F.col("top.n").alias("n"), "all")
        .filter("n < all")
        .select(
            "band", "key", "main",
            F.ceil(F.col("n") / BLOCK).cast("int").alias("mains"),
            F.ceil((F.col("all") - F.col("n")) / BLOCK).cast("int").alias("rests"),
        )
    )
    draw = F.xxhash64("id")
    in_main = F.col("label") == F.col("main")
    rest = F.pmod(draw, F.col("rests")).cast("int")
    rests = F.sequence(F.lit(0), F.col("rests") - 1)
    mains = F.sequence(F.lit(0), F.col("mains") - 1)
    tasks = F.when(
        in_main,
        F.transform(rests, lambda r: F.struct(r.alias("p"), (-1 - F.pmod(draw, F.col("mains")).cast("int")).alias("q"))),
    ).otherwise(
        F.concat(
            F.transform(rests, lambda r: F.struct(F.least(r, rest).alias("p"), F.greatest(r, rest).alias("q"))),
            F.transform(mains, lambda m: F.struct(rest.alias("p"), (-1 - m).alias("q"))),
        )
    )
    dealt = placed.join(mixed, ["band", "key"]).withColumn("task", F.explode(tasks))
    full = texts.attach(
        dealt.select("band", "key", "task.p", "task.q", "id", "label", "bands", "sketch", "weight"), "id", "text"
    )
    compare = _block_links(weights, similarity)
    return full.groupBy("band", "key", "p", "q").applyInArrow(compare, "a bigint, b bigint").distinct()


def _block_links(weights: np.ndarray, similarity: float) -> Callable[[pa.Table], pa.Table]:
    def compare(table: pa.Table) -> pa.Table:
        """Links between different components of two blocks, by their labels."""
        band = table["band"][0].as_py()
        labels, texts = table["label"].to_pylist(), table["text"].to_pylist()
        bands = np.array(table["bands"].to_pylist(), np.int64)
        sketches = np.array(table["sketch"].to_pylist(), np.int64)
        total = table["weight"].to_numpy()
        hashes, sets, parent, found = WordHashes(), {}, {x: x for x in labels}, []

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def set_of(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in sets:
                sets[i] = weighted(texts[i], hashes, weights)
            return sets[i]

        for i in range(len(labels) - 1):
            z = sketches[i] ^ sketches[i + 1 :]
            z = z | (z >> 1)
            z = z | (z >> 2)
            agree = _SAMPLES - np.bitwise_count(z & _ONES).sum(axis=1)
            w = total[i + 1 :]
            near = (agree >= LEAST_AGREEMENT) & (np.minimum(w, total[i]) >= np.maximum(w, total[i]) * (least_weighted(similarity) - 1e-6))
            # Each pair is looked at in the first band that it shares.
            near &= (bands[i] == bands[i + 1 :]).argmax(axis=1) == band
            for j in np.flatnonzero(near)[np.argsort(-agree[near], kind="stable")] + i + 1:
                if top(labels[i]) != top(labels[j]):
                    if likeness(set_of(i), set_of(j), weights) >= similarity:
                        parent[top(labels[i])] = top(labels[j])
                        found.append((min(labels[i], labels[j]), max(labels[i], labels[j])))
        columns = zip(*found, strict=True) if found else ([], [])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "b"), columns, strict=True)})

    return compare


def linked(
    texts: Texts, signed: DataFrame, weights: np.ndarray, similarity: float = SIMILARITY
) -> DataFrame:
    """(node, label) of the texts that are alike to others; the label is the smallest node of the class.

    ``signed`` has ``id``, one for each different text, and the columns of a signature.
    """
    rows = signed.select("id", F.posexplode("bands").alias("band", "key"), *FIELDS)
    full = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = settle(rows.join(full, ["band", "key"]))
    # Every member of a small bucket leads, and two of a large one.
    turn = F.row_number().over(Window.partitionBy("band", "key").orderBy(F.xxhash64("id", "band"), "id"))
    leaders = (
        members.select("band", "key", "id", "sketch", "weight", "members", turn.alias("turn"))
        .filter((F.col("turn") <= 2) | (F.col("members") <= SMALL))
        .select(
            "band", "key", F.col("id").alias("leader"),
            F.col("sketch").alias("l_sketch"), F.col("weight").alias("l_weight"),
        )
    )
    pairs = (
        leaders.join(members.select("band", "key", "id", "sketch", "weight"), ["band", "key"])
        .filter((F.col("leader") != F.col("id")) & _plausible("l_", "", similarity))
        .select(*_ordered("leader", "id"))
        .distinct()
    )
    like = settle(_measure(pairs, texts, weights).filter(F.col("similarity") >= similarity))
    labels = components(like)
    large = members.filter(F.col("members") > SMALL).drop("members")
    above = components(_large_buckets(large, labels, texts, weights, similarity))
    return relabelled(labels, above).union(above.join(labels, "node", "left_anti"))


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """Each row's key with ``class_id`` and ``copy_of``, its ``digest``, and whether it ``represents`` its class.

    ``class_id`` is the smallest key of the class and ``copy_of`` the smallest key with an equal
    text. Classes are classes of texts: two texts under one key are two nodes, and the key does not
    link them. Among the rows of a class the one of the smallest key (of equal ones the smallest
    digest) represents it, repeated rows alike. Null and empty texts are copies of each other; texts
    without words are alike only if equal; texts of fewer than five words are one shingle. Rows with
    a null key are left out, rows with equal keys are given once for each. An empty table gives an
    empty result.
    """
    docs = df.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    weights = shingle_weights(docs)
    sign = struct_udf(FIELDS, _signing(weights))
    signed = settle(
        docs.select("doc_id", F.md5("text").alias("digest"), sign("text").alias("s")).select("doc_id", "digest", "s.*")
    )
    # A node is a text; its number means nothing but is fixed, for the table is stored.
    different = settle(
        signed.groupBy("digest")
        .agg(F.min(F.struct("doc_id", *FIELDS)).alias("first"))
        .select(
            F.monotonically_increasing_id().alias("id"), "digest", F.col("first.doc_id").alias("doc_id"),
            *[f"first.{name}" for name in FIELDS],
        )
    )
    texts = Texts(different.select("id", "doc_id", "digest"), docs.withColumn("digest", F.md5("text")))
    labels = settle(linked(texts, different.drop("digest", "doc_id"), weights, similarity))
    named = (
        different.select("digest", "id", F.col("doc_id").alias("copy_of"))
        .join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("digest", "copy_of", F.coalesce("label", "id").alias("label"))
    )
    first = named.groupBy("label").agg(F.min(F.struct("copy_of", "digest")).alias("first"))
    return (
        signed.select("doc_id", "digest")
        .join(named.join(first, "label"), "digest")
        .select(
            "doc_id", F.col("first.copy_of").alias("class_id"), "copy_of", "digest",
            ((F.col("doc_id") == F.col("first.copy_of")) & (F.col("digest") == F.col("first.digest"))).alias("represents"),
        )
    )


def keep_representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with the columns it came with.

    Rows are told apart by key and text, so a text leaves only for its own class. Of repeated rows
    that represent their class one stays. Rows without a key cannot be compared and stay.
    """
    classes = settle(near_duplicates(df, key, text))
    digest, ident = fresh(df, "_digest"), fresh(df, "_ident")
    rows = df.withColumns({
        digest: F.md5(F.coalesce(F.col(text), F.lit(""))), ident: F.col(key).cast("bigint"),
    })

    def marked(some: DataFrame) -> DataFrame:
        return some.select(F.col("doc_id").alias(ident), F.col("digest").alias(digest)).distinct()

    kept = rows.join(marked(classes.filter("not represents")), [ident, digest], "left_anti")
    several = classes.filter("represents").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    once = kept.join(marked(several), [ident, digest], "left_anti")
    again = kept.join(marked(several), [ident, digest], "left_semi").dropDuplicates([ident, digest])
    return once.unionByName(again).select(*df.columns)
