"""Input files. Every schema is explicit; ``NA`` is the missing value."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from yardgrid import schemas

_WEEK = r"tracking_week_(\d+)"


def _csv(
    spark: SparkSession, path: str | list[str], schema: StructType, sep: str = ","
) -> DataFrame:
    """Columns are taken by the names of the header, so their order in each file is free.

    Every path is read by its own header. Text that is no value of the column's type fails the
    job that reads it; only ``NA`` and the empty text are missing values.
    """
    if isinstance(path, list):
        parts = [_csv(spark, alike, schema, sep) for alike in _by_header(spark, path)]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return _alike(spark, path, schema, sep)


def _by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The files of some paths, those with the same first line together; found in one job."""
    if not paths:
        return []
    lines = spark.read.text(paths).filter("trim(value) <> ''").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    found: dict[str, list[str]] = {}
    for file, header in sorted(tuple(row) for row in first.collect()):  # one row per file
        found.setdefault(header, []).append(unquote(file))
    return list(found.values())


def _alike(
    spark: SparkSession, path: str | list[str], schema: StructType, sep: str = ",", more: dict[str, Column] | None = None
) -> DataFrame:
    """Files that have one header, and ``more`` columns."""
    stored = spark.read.csv(path, header=True, sep=sep, nullValue="NA", inferSchema=False)
    found = {name.lower() for name in stored.columns}
    place = F.lit(path) if isinstance(path, str) else F.col("_metadata.file_path")

    def column(field: StructField) -> Column:
        text = F.col(field.name) if field.name.lower() in found else F.lit(None).cast("string")
        value = text.try_cast(field.dataType)
        bad = F.concat(F.lit(f"column {field.name} of "), place, F.lit(": "), text)
        return F.when(text.isNotNull() & value.isNull(), F.raise_error(bad)).otherwise(value).alias(field.name)

    return stored.select(
        *[column(field) for field in schema.fields], *[value.alias(name) for name, value in (more or {}).items()]
    )


def read_tracking(
    spark: SparkSession, folder: str, weeks: Iterable[int] | None = None
) -> DataFrame:
    """Weekly files ``tracking_week_<n>.csv`` of a folder, with the week as a column.

    Files with the same header are read as one table, so the plan does not grow with the weeks.
    """
    if weeks is None:
        paths = [f"{folder}/tracking_week_*.csv"]
    else:
        paths = [f"{folder}/tracking_week_{week}.csv" for week in weeks]
    week = {"week": F.regexp_extract(F.col("_metadata.file_path"), _WEEK, 1).cast("int")}
    weekly = [_alike(spark, alike, schemas.TRACKING, more=week) for alike in _by_header(spark, paths)]
    if not weekly:
        return spark.createDataFrame([], schemas.TRACKING).withColumn("week", F.lit(None).cast("int"))
    return reduce(DataFrame.unionByName, weekly)


def write_tracking(df: DataFrame, folder: str) -> None:
    """Write rows with their ``week`` as weekly files that :func:`read_tracking` reads, all weeks in
    one job. Rows without a week are not written."""
    spark = df.sparkSession
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    rows = df.filter("week is not null").hint("rebalance", "week")
    rows.write.partitionBy("week").csv(draft, header=True, nullValue="NA")
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(draft)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(place):  # one folder a week
        name = status.getPath().getName()
        if name.startswith("week="):
            target = f"{folder}/tracking_week_{name.removeprefix('week=')}.csv"
            if not system.rename(status.getPath(), hadoop.Path(target)):
                raise FileExistsError(target)


def read_plays(spark: SparkSession, path: str) -> DataFrame:
    """Plays."""
    return _csv(spark, path, schemas.PLAYS)


def read_tackles(spark: SparkSession, path: str) -> DataFrame:
    """Tackle records."""
    return _csv(spark, path, schemas.TACKLES)


def read_players(spark: SparkSession, path: str) -> DataFrame:
    """Players."""
    return _csv(spark, path, schemas.PLAYERS)


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Games."""
    return _csv(spark, path, schemas.GAMES)


def read_pbp(spark: SparkSession, path: str) -> DataFrame:
    """Play-by-play records from a supplied CSV or Parquet file."""
    if path.endswith(".csv") or path.endswith(".csv.gz"):
        return _csv(spark, path, schemas.PLAY_BY_PLAY)
    stored = spark.read.parquet(path)
    return stored.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PLAY_BY_PLAY.fields]
    )


def read_rosters(spark: SparkSession, path: str) -> DataFrame:
    """Rosters from a supplied CSV or Parquet file."""
    if path.endswith(".csv") or path.endswith(".csv.gz"):
        return _csv(spark, path, schemas.ROSTERS)
    stored = spark.read.parquet(path)
    return stored.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.ROSTERS.fields]
    )


def read_team_colors(spark: SparkSession, path: str) -> DataFrame:
    """Team colours, tab-separated."""
    return _csv(spark, path, schemas.TEAM_COLORS, sep="\t")
