"""How the sources of a language differ in their words.

Every language keeps the terms of at least ``LEAST_DOCUMENTS`` of its documents. A (language, source)
group gives a kept term the smoothed share ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))`` of its words,
a whole language likewise. Two sources are as far apart as the sum of the differences of their shares
over all kept terms, and a group's own terms are those with a larger share than in its language.

Duplicate texts are collapsed: equal texts of a language are read once, with the number of their rows
in every source, and each of their terms adds to document frequencies and counts with that weight. Only
sums by (language, source, term) leave the tasks that hold the texts.

Pairs are evaluated sparsely. A term that a group lacks has the group's base share ``z``. With
A and B the terms of the two groups, the distance is

    V |z_a - z_b| + sum over A of (|p_a - z_b| - |z_a - z_b|) + the same over B
    + sum over A and B of (|p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|)

The first sums need only how many terms of a group have each count; the last one joins the terms of two
groups. Counts are summed as longs, shares are divided as decimals, so all values are exact.

Defined results: null text, lang and source are empty strings, which are a language and a source like
others; equal rows count as often as they occur; a group without terms still has its pairs; a language
that keeps no term has only pairs of value 0; an empty table gives an empty result. Other columns of
the table are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardgrid.llm.common import filled
from yardgrid.session import settle

# Every byte of UTF-8 text in a term as it is, A to Z in lower case, all others a space: bytes from
# 0x80 on belong to characters beyond ASCII, and all of these are parts of terms.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
# Sums a task keeps before it hands them on.
HELD = 400_000
LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def _task_sums(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sums by (lang, source, term) of the texts of a task, handed on in parts of bounded size.

    Rows of one text are neighbours, so the text is split for the first of them only.
    """
    sums: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    held, last, terms = 0, None, {}

    def part() -> pa.RecordBatch:
        rows = [(lang, source, term, n, df) for (lang, source), found in sums.items() for term, (n, df) in found.items()]
        columns = zip(*rows, strict=True)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], ["lang", "source", "term", "n", "df"])

    for batch in batches:
        for lang, digest, text, source, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (lang, digest) != last:
                last, terms = (lang, digest), Counter(terms_of(text))
            found = sums.setdefault((lang, source), {})
            before = len(found)
            for term, n in terms.items():
                pair = found.get(term)
                if pair is None:
                    found[term] = [n * copies, copies]
                else:
                    pair[0] += n * copies
                    pair[1] += copies
            held += len(found) - before
            if held >= most:
                yield part()
                sums, held = {}, 0
    if held:
        yield part()


def term_counts(df: DataFrame) -> DataFrame:
    """Occurrences ``n`` of every term in every (lang, source), and the documents ``df`` with it.

    Each distinct text of a language is split once and weighted with its rows in each source. The
    result is partitioned by language and term.
    """
    rows = df.select(
        filled("lang").alias("lang"), filled("source").alias("source"), filled("text").alias("text")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = rows.groupBy("lang", "digest").agg(F.max("text").alias("text"))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("copies"))
    return (
        texts.join(copies, ["lang", "digest"])
        .select("lang", "digest", "text", "source", "copies")
        .mapInArrow(partial(_task_sums, most=HELD), "lang string, source string, term string, n bigint, df bigint")
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    )


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The counts of terms that enough documents of the language have; ``all_n`` is its total.

    A term has one row per source, and they are together already.
    """
    term = Window.partitionBy("lang", "term")
    summed = counts.withColumns({"all_df": F.sum("df").over(term), "all_n": F.sum("n").over(term)})
    return summed.filter(F.col("all_df") >= least).select("lang", "source", "term", "n", "all_n")


def share(n: str, words: str, terms: str) -> Column:
    """The smoothed share of a term, as an exact integer; null where there are no terms."""
    return F.expr(
        f"cast(1 + (cast({n} + {SMOOTHING} as decimal(20)) * {SCALE})"
        f" div nullif(cast({words} as decimal(20)) + {SMOOTHING} * {terms}, 0) as bigint)"
    )


def shares(df: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups with their base share ``z``, and the kept terms with the shares of group and language."""
    langs = (
        kept.groupBy("lang", "term").agg(F.max("all_n").alias("all_n"))
        .groupBy("lang").agg(F.count(F.lit(1)).alias("kept_terms"), F.sum("all_n").alias("all_words"))
    )
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = (
        df.select(filled("lang").alias("lang"), filled("source").alias("source")).distinct()
        .join(words, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(0, ["words", "kept_terms", "all_words"])
        .withColumn("none", F.lit(0).cast("bigint"))
        .withColumn("z", share("none", "words", "kept_terms"))
        .drop("none")
    )
    terms = (
        kept.join(groups, ["lang", "source"])
        .select("lang", "source", "term", "n", "z", share("n", "words", "kept_terms").alias("p"), share("all_n", "all_words", "kept_terms").alias("q"))
    )
    return groups, terms


def pair_distances(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """The distance of every two sources of a language, each pair in both directions."""
    side = groups.select("lang", "source", "z", "kept_terms")
    other = side.select("lang", F.col("source").alias("item"), F.col("z").alias("z_item"))
    pairs = side.join(other, "lang").filter("source < item")
    base = F.abs(F.col("z") - F.col("z_item"))
    flat = pairs.select("lang", "source", "item", (F.col("kept_terms") * base).alias("part"))
    # How many terms of a group have each share, against the base share of every other source.
    spread = terms.groupBy("lang", "source", "z", "p").agg(F.count(F.lit(1)).alias("terms"))
    one = spread.join(other, "lang").filter("source <> item").select(
        "lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"),
        (F.col("terms") * (F.abs(F.col("p") - F.col("z_item")) - base)).alias("part"),
    )
    right = terms.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_item"), F.col("z").alias("z_item"))
    both = terms.join(right, ["lang", "term"]).filter("source < item").select(
        "lang", "source", "item",
        (
            F.abs(F.col("p") - F.col("p_item")) - F.abs(F.col("p") - F.col("z_item"))
            - F.abs(F.col("z") - F.col("p_item")) + base
        ).alias("part"),
    )

    def summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy("lang", "source", "item").agg(F.sum("part").alias("part"))

    whole = (
        summed(summed(flat).unionByName(summed(one)).unionByName(summed(both)))
        .select("lang", "source", "item", F.coalesce("part", F.lit(0)).cast("bigint").alias("value"))
    )
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return whole.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def source_divergence(df: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Ranked distances between sources (part ``pair``) and ranked own terms of a source (``term``)."""
    kept = settle(kept_terms(term_counts(df), least))
    groups, terms = shares(df, kept)
    groups, terms = settle(groups), settle(terms)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = pair_distances(groups, terms).withColumn("part", F.lit("pair"))
    own = (
        terms.filter("n > 0 and p > q")
        .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("part", F.lit("term"))
    )
    columns = ["lang", "source", "part", "item", "value"]
    return pairs.select(*columns, rank).unionByName(own.select(*columns, rank).filter(F.col("rank") <= top))
