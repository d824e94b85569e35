"""The weekly run, stage by stage, through partitioned tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardgrid.operators.clean import clean_tracking
from yardgrid.operators.control import (
    control_surface,
    control_value,
    framed_sides,
    value_surface,
    without_carrier,
)
from yardgrid.operators.influence import influence
from yardgrid.operators.quality import quality_summary, tackler_ellipses
from yardgrid.operators.tackles import tackle_frames
from yardgrid.session import settle
from yardgrid.sources.stages import game_buckets, read_stage, write_stage

CELL_STAGES = ("influence", "pitch_control", "value_map")


@dataclass(frozen=True)
class Inputs:
    """Tables of a run; ``tracking`` has a ``week`` column."""

    tracking: DataFrame
    plays: DataFrame
    pbp: DataFrame
    tackles: DataFrame


def _with_parts(df: DataFrame, parts: DataFrame, game: str = "game") -> DataFrame:
    """Week and bucket of the game. The part table is read from storage, so Spark knows its size
    and broadcasts it while that is below the session's threshold."""
    return df.join(parts.withColumnRenamed("game", game), game)


def run_weeks(
    spark: SparkSession,
    inputs: Inputs,
    root: str,
    weeks: Iterable[int] | None = None,
    cell_stages: Iterable[str] = CELL_STAGES,
) -> None:
    """Clean, spread, control and grade the given weeks, each stage written before the next.

    Stages: ``parts``, ``clean``, the chosen cell tables, ``quality`` and ``all_quality``. Quality
    reads the cleaned frames, not the cell tables, which are for consumers of the surfaces.
    """
    tracking = inputs.tracking
    if weeks is not None:
        weeks = list(weeks)  # read several times
        tracking = tracking.filter(F.col("week").isin(weeks))
    games = tracking.select("week", F.col("gameId").alias("game")).distinct()
    write_stage(game_buckets(games), root, "parts", rebalance=True, weeks=weeks)
    parts = read_stage(spark, root, "parts", weeks)

    clean = clean_tracking(tracking.drop("week"), inputs.plays, inputs.pbp)
    write_stage(_with_parts(clean, parts, "gameId"), root, "clean", rebalance=True, weeks=weeks)
    clean = read_stage(spark, root, "clean", weeks).drop("week", "bucket")
    frames = settle(framed_sides(clean, inputs.plays))

    surfaces = {
        "influence": lambda: influence(clean),
        "pitch_control": lambda: control_surface(without_carrier(frames)),
        "value_map": lambda: value_surface(frames),
    }
    for stage in cell_stages:
        write_stage(_with_parts(surfaces[stage](), parts), root, stage, weeks=weeks)

    write_stage(_with_parts(control_value(frames), parts), root, "control_value", weeks=weeks)
    cells = read_stage(spark, root, "control_value", weeks).drop("week", "bucket")
    for stage, only_tacklers in (("quality", True), ("all_quality", False)):
        followed = tackle_frames(clean, inputs.plays, inputs.tackles, only_tacklers)
        graded = quality_summary(cells, tackler_ellipses(followed))
        write_stage(_with_parts(graded, parts), root, stage, rebalance=True, weeks=weeks)
