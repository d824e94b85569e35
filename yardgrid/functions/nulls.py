"""Missing-value rules of the data model where they differ from Spark's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict(aggregate: Column, value: Column | str) -> Column:
    """``aggregate``, or null when any input of the group is missing."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def larger(a: Column, b: Column) -> Column:
    """Row-wise maximum; null when either side is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def smaller(a: Column, b: Column) -> Column:
    """Row-wise minimum; null when either side is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def surely(condition: Column) -> Column:
    """The condition with unknown read as false."""
    return F.coalesce(condition, F.lit(False))


def choose(condition: Column, yes, no) -> Column:
    """Two-way choice whose result is null when the condition is unknown."""
    return F.when(condition, yes).when(~condition, no)


def any_of(column: str, values) -> Column:
    """Set membership; a missing value is in no set."""
    return surely(F.col(column).isin(list(values)))


def join_alike(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing key matches a missing key; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def zero_nulls(df: DataFrame, value: float = 0) -> DataFrame:
    """Replace missing numbers in every numeric column."""
    return df.fillna(value)
