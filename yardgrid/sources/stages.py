"""Stage tables: Parquet directories partitioned by week and range of games, with an index of their parts."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yardgrid.functions.nulls import join_alike
from yardgrid.session import fan_out, settle

PARTS = ("week", "bucket")
FRAME_KEYS = ("game", "play", "frame")
SNAPSHOTS = "_snapshots"
INDEX = (
    "version string, week int, bucket int, file string, game bigint, rows bigint, first_play bigint, last_play bigint"
)


def game_buckets(games: DataFrame, n: int = 4) -> DataFrame:
    """week, game, bucket: the games of a week in ``n`` contiguous ranges of nearly equal number.

    ``games`` has one row per game (a week holds a few dozen), so the window is small however
    large the frames are.
    """
    order = Window.partitionBy("week").orderBy("game")
    position = F.row_number().over(order)
    total = F.count(F.lit(1)).over(Window.partitionBy("week"))
    return games.select("week", "game").distinct().withColumn(
        "bucket", (F.ceil(n * position / total) - 1).cast("int")
    )


def partition_by_game(df: DataFrame, game: str = "game", n: int = 4) -> DataFrame:
    """Adds ``bucket`` to rows that have ``week`` and a game.

    The distinct games are few rows next to the frames; how they are joined is left to the
    session's broadcast threshold.
    """
    games = df.select("week", F.col(game).alias("game")).distinct()
    buckets = game_buckets(games, n).withColumnRenamed("game", game)
    return df.join(buckets, ["week", game])


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _snapshots(spark: SparkSession, root: str, stage: str) -> list[int]:
    """The numbers of the published snapshots, ascending."""
    place, system = _hadoop(spark, f"{root}/{stage}/{SNAPSHOTS}")
    if not system.exists(place):
        return []
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(int(name) for name in names if name.isdigit())


def part_index(spark: SparkSession, root: str, stage: str, snapshot: int | None = None) -> DataFrame:
    """What a snapshot of a stage holds, the last one by default: a row per file and game.

    ``version``, ``week`` and ``bucket`` name the folder; ``rows``, ``first_play`` and ``last_play``
    tell what the file has of the ``game``.
    """
    numbers = _snapshots(spark, root, stage)
    if not numbers:
        raise FileNotFoundError(f"stage {stage} in {root} has no snapshot")
    number = numbers[-1] if snapshot is None else snapshot
    return spark.read.schema(INDEX).parquet(f"{root}/{stage}/{SNAPSHOTS}/{number}")


def _described(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """The index rows of the files of one version, from their narrow columns."""
    files = spark.read.parquet(folder)
    names = {c.lower(): c for c in files.columns}

    def column(*choices: str, kind: str) -> Column:
        found = next((names[c.lower()] for c in choices if c.lower() in names), None)
        return (F.col(found) if found else F.lit(None)).cast(kind)

    return (
        files.select(
            F.lit(version).alias("version"),
            column("week", kind="int").alias("week"),
            column("bucket", kind="int").alias("bucket"),
            F.col("_metadata.file_path").alias("file"),
            column("game", "gameId", kind="bigint").alias("game"),
            column("play", "playId", kind="bigint").alias("play"),
        )
        .groupBy("version", "week", "bucket", "file", "game")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("play").alias("first_play"), F.max("play").alias("last_play"))
    )


def _publish(spark: SparkSession, index: DataFrame, root: str, stage: str, number: int) -> None:
    """Make a snapshot visible by one rename, which fails where the number is taken already."""
    folder = f"{root}/{stage}/{SNAPSHOTS}"
    draft = f"{folder}/draft-{uuid.uuid4().hex}"
    index.coalesce(1).write.parquet(draft)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(draft), hadoop.Path(f"{folder}/{number}")
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    context = hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    context.rename(source, target, plain)


def write_stage(
    df: DataFrame, root: str, stage: str, rebalance: bool = False, rows_per_file: int = 5_000_000,
    weeks: Iterable[int] | None = (),
) -> None:
    """Write a stage; the partitions present in ``df`` are replaced, as one step.

    The rows go to a folder of their own version. Then a new snapshot is published: an index of the
    files that make up the stage, in which the new partitions take the place of the old ones. A
    reader uses one snapshot, so it sees the stage before or after the step and never a mixture,
    also when the run stops anywhere in between, and of two runs at the same time the second one
    fails. Of the given ``weeks`` (of all for None) partitions that got no rows this time leave the
    stage, so a second run over a week replaces the whole week and keeps the others. Files of older
    snapshots stay for their readers until :func:`drop_snapshots`.

    Narrow tables may be rebalanced first: few files per partition, in the order of games, plays
    and frames, with partitions that hold most rows cut into several. Cell tables are written from
    the tasks that made them.
    """
    spark = df.sparkSession
    parts = [name for name in PARTS if name in df.columns]
    number = (_snapshots(spark, root, stage) or [0])[-1] + 1
    version = f"{number}-{uuid.uuid4().hex}"
    folder = f"{root}/{stage}/version={version}"
    placed = df
    if rebalance and parts:
        order = [c for c in ("game", "gameId", "play", "playId", "frame", "frameId") if c in df.columns]
        placed = df.hint("rebalance", *parts).sortWithinPartitions(*parts, *order)
    placed.write.option("maxRecordsPerFile", rows_per_file).partitionBy(*parts).parquet(folder)
    index = settle(_described(spark, folder, version)) if _holds_files(spark, folder) else spark.createDataFrame([], INDEX)
    if number > 1:
        index = _replacing(spark, index, root, stage, number - 1, weeks, bool(parts))
    _publish(spark, index, root, stage, number)


def _replacing(
    spark: SparkSession, index: DataFrame, root: str, stage: str, last: int, weeks: Iterable[int] | None, parted: bool
) -> DataFrame:
    """The index of the next snapshot: the new rows, and the old ones of partitions that stay."""
    old = part_index(spark, root, stage, last)
    gone = F.lit(True) if weeks is None or not parted else F.col("week").isin([int(w) for w in weeks])
    places = index.select("week", "bucket").distinct().withColumn("new", F.lit(True))
    kept = join_alike(old.filter(~F.coalesce(gone, F.lit(False))), places, ["week", "bucket"], "left")
    return kept.filter("new is null").select(*index.columns).unionByName(index)


def write_by_frame(
    df: DataFrame, root: str, stage: str, buckets: int | None = None, weeks: Iterable[int] | None = (),
    keys: Sequence[str] = FRAME_KEYS,
) -> None:
    """Write a cell table bucketed and sorted by frame, published like :func:`write_stage`.

    Stages with the same number of buckets (the session's shuffle partitions by default) are joined
    and grouped by frame where they lie, without another exchange. Rows should come partitioned by
    frame, so that a task writes one file. A table with a ``week`` replaces the weeks it has rows
    of and the given ones.
    """
    spark = df.sparkSession
    number = (_snapshots(spark, root, stage) or [0])[-1] + 1
    version = f"{number}-{buckets or fan_out(spark)}-{uuid.uuid4().hex}"
    folder = f"{root}/{stage}/version={version}"
    writer = df.write.format("parquet").option("path", folder)
    writer.bucketBy(buckets or fan_out(spark), *keys).sortBy(*keys).saveAsTable(_table_name(folder))
    index = settle(_described(spark, folder, version)) if _holds_files(spark, folder) else spark.createDataFrame([], INDEX)
    if number > 1:
        index = _replacing(spark, index, root, stage, number - 1, weeks, "week" in df.columns)
    _publish(spark, index, root, stage, number)


def _table_name(folder: str) -> str:
    """A catalogue name that depends on nothing but the folder."""
    return "by_frame_" + hashlib.md5(folder.encode()).hexdigest()


def read_by_frame(
    spark: SparkSession, root: str, stage: str, weeks: Iterable[int] | None = None, snapshot: int | None = None,
    keys: Sequence[str] = FRAME_KEYS,
) -> DataFrame:
    """Read a table of :func:`write_by_frame`; the plan knows how its rows are bucketed.

    The versions that make up the snapshot are the partitions of one catalogue table, which a session
    that has not read it yet enters first. All of them must have the same number of buckets.
    """
    number = _snapshots(spark, root, stage)[-1] if snapshot is None else snapshot
    held = part_index(spark, root, stage, number).groupBy("version").agg(F.collect_set("week").alias("weeks")).collect()
    if not held:
        raise FileNotFoundError(f"stage {stage} in {root} holds no rows")
    counts = {version.split("-")[1] for version, _ in held}
    if len(counts) > 1:
        raise ValueError(f"stage {stage} in {root} has versions of {sorted(counts)} buckets; write its weeks anew")
    name = _table_name(f"{root}/{stage}/{number}")
    if not spark.catalog.tableExists(name):
        columns = spark.read.parquet(f"{root}/{stage}/version={held[0][0]}").schema.toDDL()
        spark.sql(
            f"CREATE TABLE {name} ({columns}, version string) USING parquet PARTITIONED BY (version)"
            f" CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {counts.pop()} BUCKETS"
            f" LOCATION '{root}/{stage}'"
        )
        for version, _ in held:
            spark.sql(f"ALTER TABLE {name} ADD PARTITION (version = '{version}') LOCATION '{root}/{stage}/version={version}'")
    # A version may hold weeks that a later one has replaced.
    own = F.lit(False)
    for version, of_version in held:
        own |= (F.col("version") == version) & (F.col("week").isin(of_version) if of_version else F.lit(True))
    table = spark.table(name).filter(own)
    if weeks is not None:
        table = table.filter(F.col("week").isin(list(weeks)))
    return table.drop("version")


def _holds_files(spark: SparkSession, folder: str) -> bool:
    """Whether a written table has a data file; a partitioned table without rows has none."""
    place, system = _hadoop(spark, folder)
    files = system.listFiles(place, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def drop_snapshots(spark: SparkSession, root: str, stage: str, keep: int = 1) -> None:
    """Remove all but the last ``keep`` snapshots and the files that only they hold.

    For times when no older snapshot is being read and no run is writing.
    """
    numbers = _snapshots(spark, root, stage)
    gone = numbers[: max(0, len(numbers) - max(1, keep))]
    wanted: set[str] = set()
    for number in numbers[len(gone):]:  # one row per part, not per file
        rows = part_index(spark, root, stage, number).select("version", "week", "bucket").distinct().collect()
        wanted |= {_part_folder(root, stage, *row) for row in rows}
    for number in gone:
        rows = part_index(spark, root, stage, number).select("version", "week", "bucket").distinct().collect()
        for folder in {_part_folder(root, stage, *row) for row in rows} - wanted:
            place, system = _hadoop(spark, folder)
            system.delete(place, True)
        place, system = _hadoop(spark, f"{root}/{stage}/{SNAPSHOTS}/{number}")
        system.delete(place, True)


def _part_folder(root: str, stage: str, version: str, week: int | None, bucket: int | None) -> str:
    path = f"{root}/{stage}/version={version}"
    if week is not None:
        path += f"/week={week}"
    return path if bucket is None else f"{path}/bucket={bucket}"


def _stored(spark: SparkSession, root: str, stage: str, snapshot: int | None) -> DataFrame:
    """The rows of a snapshot with their ``version``; only its folders are listed."""
    parts = part_index(spark, root, stage, snapshot).select("version", "week", "bucket").distinct().collect()
    folders = [_part_folder(root, stage, *row) for row in parts]
    if not folders:
        raise FileNotFoundError(f"stage {stage} in {root} holds no rows")
    return spark.read.option("basePath", f"{root}/{stage}").parquet(*sorted(folders))


def read_stage(
    spark: SparkSession,
    root: str,
    stage: str,
    weeks: Iterable[int] | None = None,
    games: DataFrame | None = None,
    game: str = "game",
    snapshot: int | None = None,
) -> DataFrame:
    """Read a stage, optionally some weeks (partition pruning) or the games of another table.

    The last snapshot is read unless an older one is named.
    """
    df = _stored(spark, root, stage, snapshot).drop("version")
    if weeks is not None:
        df = df.filter(F.col("week").isin(list(weeks)))
    if games is not None:
        df = df.join(games.select(game).distinct(), game, "left_semi")
    return df


def stage_lookup(
    spark: SparkSession, root: str, stage: str, wanted: DataFrame, snapshot: int | None = None
) -> DataFrame:
    """The rows of some games, plays or frames of a stage, from the folders that hold them.

    ``wanted`` has the key columns of the stage that count: the game, perhaps the play, perhaps the
    frame. The index says which parts have such plays; the stage is joined to these parts on its
    partition columns, so Spark prunes its folders while the query runs.
    """
    df = _stored(spark, root, stage, snapshot)
    keys = [c for c in df.columns if c in wanted.columns]
    game = next(c for c in keys if c in ("game", "gameId"))
    play = next((c for c in keys if c in ("play", "playId")), None)
    plays = wanted.select(F.col(game).cast("bigint").alias("game"), *([F.col(play).alias("_play")] if play else [])).distinct()
    # The comparison also tells Spark that the parts are a selection, for which pruning pays.
    index = part_index(spark, root, stage, snapshot).filter("rows > 0")
    match = index.join(plays, "game")
    if play:
        match = match.filter(F.col("_play").between(F.col("first_play"), F.col("last_play")))
    parts = [c for c in ("version", *PARTS) if c in df.columns]
    held = match.select(*parts).distinct()
    pruned = df.join(held, parts, "left_semi")
    found = pruned.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return found.select(*[c for c in df.columns if c != "version"])


def stored_slice(
    spark: SparkSession, root: str, stage: str, game: int, play: int, frame: int | None = None,
    snapshot: int | None = None,
) -> DataFrame:
    """The rows of one play, or of one frame of it, of a stored stage.

    Only the part of the game is opened; inside it the values are compared with the statistics of
    the files.
    """
    df = _stored(spark, root, stage, snapshot)
    names = [next(c for c in pair if c in df.columns) for pair in (("game", "gameId"), ("play", "playId"))]
    if frame is not None:
        names.append("frame" if "frame" in df.columns else "frameId")
    condition = F.lit(True)
    for name, value in zip(names, (game, play, frame), strict=False):
        condition &= F.col(name) == int(value)
    parts = [c for c in ("version", *PARTS) if c in df.columns]
    held = (
        part_index(spark, root, stage, snapshot)
        .filter((F.col("game") == int(game)) & F.lit(int(play)).between(F.col("first_play"), F.col("last_play")))
        .select(*parts).distinct()
    )
    found = df.filter(condition).join(held, parts, "left_semi")
    return found.select(*[c for c in df.columns if c != "version"])
