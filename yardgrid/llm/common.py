"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows handed to a Python task at once. Texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 24


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the size of the batches that go to Python tasks and of plans kept as text."""
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table of documents."""
    return prepare(spark).read.parquet(f"{folder}/documents.parquet")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Another given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def filled(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """True for the quarter of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bits(*parts: Column | str) -> Column:
    """64 hashed bits of some columns, as a long."""
    return F.xxhash64(*[F.col(p) if isinstance(p, str) else p for p in parts])


def fresh(df: DataFrame, base: str) -> str:
    """A column name the table does not have, ignoring case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


# Arrow types of the columns that tasks return, by their SQL names.
ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}


def value_udf(kind: str, make: Callable[[], Callable[[Any], Any]]) -> Callable[..., Column]:
    """A column function from one value to one value.

    ``make`` runs once in each task and returns the function for the single values.
    """

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for batch in batches:
            yield pa.array([each(x) for x in batch.to_pylist()], ARROW[kind])

    return run


def struct_udf(
    fields: dict[str, str], make: Callable[[], Callable[[Any], tuple[Any, ...]]]
) -> Callable[..., Column]:
    """Like :func:`value_udf`, for a function that returns a tuple with the given fields."""

    @F.arrow_udf("struct<" + ",".join(f"{n}:{k}" for n, k in fields.items()) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for batch in batches:
            rows = [each(x) for x in batch.to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            yield pa.StructArray.from_arrays(
                [pa.array(c, ARROW[k]) for c, k in zip(columns, fields.values(), strict=True)],
                names=list(fields),
            )

    return run
