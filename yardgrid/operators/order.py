"""Ordered operators that never put a whole group into one task.

A plain window over a group sorts that group in one task. Here the order column is cut into
chunks; windows run inside a chunk and over one total per chunk, and the two parts are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardgrid.functions.nulls import join_alike


def running_total(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    span: int = 1024,
) -> DataFrame:
    """Sum of ``value`` over all rows of the group up to and including the row's position.

    Rows at the same position share the total. The total is null from the first missing value on.
    """
    keys, order = list(keys), list(order)
    steps = (
        df.groupBy(*keys, *order)
        .agg(
            F.coalesce(F.sum(value), F.lit(0.0)).alias("_step"),
            F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).alias("_gaps"),
        )
        .withColumn("_chunk", F.struct(*order[:-1], F.floor(F.col(order[-1]) / span).alias("_part")))
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = (
        steps.groupBy(*keys, "_chunk")
        .agg(F.sum("_step").alias("_step"), F.sum("_gaps").alias("_gaps"))
        .select(
            *keys,
            "_chunk",
            F.coalesce(F.sum("_step").over(before), F.lit(0.0)).alias("_sum_before"),
            F.coalesce(F.sum("_gaps").over(before), F.lit(0)).alias("_gaps_before"),
        )
    )
    totals = (
        steps.withColumns(
            {"_sum": F.sum("_step").over(inside), "_missing": F.sum("_gaps").over(inside)}
        )
        .join(offsets, [*keys, "_chunk"])
        .select(
            *keys,
            *order,
            F.when(
                F.col("_missing") + F.col("_gaps_before") == 0,
                F.col("_sum_before") + F.col("_sum"),
            ).alias(out),
        )
    )
    return df.join(totals, [*keys, *order], "left")


def next_value(
    df: DataFrame, value: str, keys: Sequence[str], order: str, out: str, span: int = 256
) -> DataFrame:
    """The value of the following row of the group; null on the last row."""
    keys = list(keys)
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / span))
    held = F.struct(F.col(value).alias("v"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    heads = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.min_by(held, F.col(order)).alias("_head"))
        .select(*keys, "_chunk", F.lead("_head").over(across).alias("_following"))
    )
    return (
        chunked.withColumn("_next", F.lead(held).over(inside))
        .join(heads, [*keys, "_chunk"], "left")
        .withColumn(out, F.coalesce("_next", "_following")["v"])
        .drop("_chunk", "_next", "_following")
    )


def value_ranks(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    bucket: Column | None = None,
    buckets: int = 128,
) -> DataFrame:
    """One row per distinct value: how often it occurs (``n``), how many rows of the group lie
    ``below`` it, and the group's ``total``.

    Equal values are counted first, so copies cost nothing. The rest is ranked inside buckets of
    the value range; ``bucket`` must not decrease with the value. By default the bucket bounds are
    approximate quantiles of all values, taken by a one-row scalar subquery.
    """
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if bucket is None:
        shares = [i / buckets for i in range(1, buckets)]
        bounds = counts.agg(F.percentile_approx(value, shares, 10_000).alias("bounds"))
        placed = counts.withColumn("_bounds", bounds.scalar()).withColumn(
            "_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(value)))
        )
    else:
        placed = counts.withColumn("_bucket", bucket)
    placed = placed.drop("_bounds")
    group = Window.partitionBy(*by)
    offsets = (
        placed.groupBy(*by, "_bucket")
        .agg(F.sum("n").alias("_n"))
        .select(
            *by,
            "_bucket",
            F.coalesce(
                F.sum("_n").over(
                    group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
            F.sum("_n").over(group).alias("total"),
        )
    )
    inside = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        join_alike(placed.withColumn("_upto", F.sum("n").over(inside)), offsets, [*by, "_bucket"])
        .select(
            *by,
            value,
            "n",
            (F.col("_before") + F.col("_upto") - F.col("n")).alias("below"),
            "total",
        )
    )


def _bounds_below(value: Column, bounds: Column, first: int, last: int) -> Column:
    """How many of the ascending bounds are smaller than a value, by bisection: a few comparisons
    a row, where a function over the array would visit all of it."""
    if first == last:
        return F.lit(first)
    middle = (first + last) // 2
    return F.when(
        F.get(bounds, F.lit(middle)) < value, _bounds_below(value, bounds, middle + 1, last)
    ).otherwise(_bounds_below(value, bounds, first, middle))


def ranks_around(
    df: DataFrame, value: str, ranks: Sequence[Column], by: Sequence[str] = (), bucket: Column | None = None,
    buckets: int = 32, finer: Column | None = None, made: Column | None = None,
) -> DataFrame:
    """The rows of :func:`value_ranks` near some ranks (counted from 0, columns of ``total``).

    The rows of each bucket are counted where they lie; only the buckets that hold a wanted rank are
    then read again, and only their rows travel. ``df`` is read three times (twice with a given
    ``bucket``), so it should be a stored table. The chosen buckets are at most as many as the groups
    times the ranks.

    With ``finer``, which must not decrease with the value inside a bucket, the rows of the chosen
    buckets are counted by it first, and only those of the parts that hold a wanted rank travel.
    ``made`` is the value, never missing, of a table that has no such column; it is worked out in the
    chosen buckets only.
    """
    by = list(by)
    known = df.filter(F.col(value).isNotNull()).select(*by, value) if made is None else df
    if bucket is None:
        shares = [i / buckets for i in range(1, buckets)]
        bounds = known.agg(F.percentile_approx(value, shares, 100 * buckets).alias("bounds"))
        known = known.withColumn("_bounds", bounds.scalar())
        known = known.withColumn("_bucket", _bounds_below(F.col(value), F.col("_bounds"), 0, buckets - 1)).drop("_bounds")
    else:
        known = known.withColumn("_bucket", bucket)
    group = Window.partitionBy(*by)
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = known.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_bucket", "_n", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("total"),
    )
    held = F.lit(False)
    for rank in ranks:
        held |= (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    chosen = sizes.filter(held).drop("_n")
    places = [*by, "_bucket"]
    # Most rows go by a look into a short list; only the others are looked up by all keys. The chosen
    # buckets are few rows, so the long side stays where it is.
    listed = F.array_contains(chosen.agg(F.collect_set("_bucket")).scalar(), F.col("_bucket"))
    rows = join_alike(known.filter(listed), F.broadcast(chosen), places)
    if made is not None:
        rows = rows.withColumn(value, made)
    if finer is not None:
        rows = rows.withColumn("_part", finer)
        upto = Window.partitionBy(*places).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = rows.groupBy(*places, "_before", "total", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
            "_before", F.col("_before") + F.coalesce(F.sum("_n").over(upto), F.lit(0))
        )
        places = [*places, "_part"]
        rows = join_alike(rows.drop("_before", "total"), F.broadcast(sizes.filter(held).drop("_n")), places)
    counts = rows.groupBy(*places, "_before", "total", value).agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*places).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.col("_before") + F.sum("n").over(inside) - F.col("n")
    return counts.select(*by, value, "n", below.alias("below"), "total")


def exact_quantiles(
    df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), bucket: Column | None = None
) -> DataFrame:
    """Quantiles with linear interpolation between the two neighbouring order statistics.

    A ``bucket`` is that of :func:`ranks_around`."""
    by = list(by)
    positions = [(F.col("total") - 1) * F.lit(share) for share in shares.values()]
    ends = [end for position in positions for end in (F.floor(position), F.ceil(position))]
    ranked = ranks_around(df, value, ends, by, bucket)
    low_n, high_n = F.col("below"), F.col("below") + F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((low_n <= rank) & (rank < high_n), F.col(value)))

    parts, columns = [F.max("total").alias("n")], {}
    for name, share in shares.items():
        position = (F.col("total") - 1) * F.lit(share)
        parts += [
            at(F.floor(position)).alias(f"_{name}_lo"),
            at(F.ceil(position)).alias(f"_{name}_hi"),
            F.max(position - F.floor(position)).alias(f"_{name}_w"),
        ]
        lo, hi, w = (F.col(f"_{name}_{end}") for end in ("lo", "hi", "w"))
        columns[name] = lo + (hi - lo) * w
    grouped = ranked.groupBy(*by).agg(*parts)
    return grouped.select(*by, "n", *[c.alias(k) for k, c in columns.items()])
