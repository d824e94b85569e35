"""Contact frames with their outcome, and probabilities read off the stored curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardgrid.functions.nulls import choose, strict
from yardgrid.functions.scoring import tackle_probability
from yardgrid.operators.clean import broken_plays
from yardgrid.operators.influence import CELL_FRAME
from yardgrid.operators.order import next_value


def label_tackles(tackles: DataFrame) -> DataFrame:
    """game, play, tackler, tackling: 1 for a tackle or an assist, 0 for a missed tackle."""
    missed = F.col("pff_missedTackle")
    clear = (F.col("tackle") != missed) | (F.col("assist") != missed)
    success = (F.col("tackle") == 1) | (F.col("assist") == 1)
    return tackles.filter(clear).select(
        F.col("gameId").alias("game"),
        F.col("playId").alias("play"),
        F.col("nflId").alias("tackler"),
        choose(success, 1, 0).alias("tackling"),
    )


def with_frame_before(quality: DataFrame) -> DataFrame:
    """``frame_before``: the contact flag of the tackler's following frame."""
    return next_value(quality, "min_dist", ["game", "play", "tackler"], "frame", "frame_before")


def contact_rows(quality: DataFrame, max_distance: float = 2) -> DataFrame:
    """Closest-approach frames within reach of the carrier."""
    return quality.filter((F.col("min_dist") == 1) & (F.col("distance") <= max_distance))


def contact_set(
    quality: DataFrame, tackles: DataFrame, pbp: DataFrame, max_distance: float = 2
) -> DataFrame:
    """Labelled contacts outside scrambles and fumbles, without duplicates."""
    broken = broken_plays(pbp).select(
        F.col("game_id").alias("game"), F.col("play_id").alias("play")
    )
    contacts = contact_rows(with_frame_before(quality), max_distance)
    return (
        contacts.join(label_tackles(tackles), ["game", "play", "tackler"])
        .join(broken, ["game", "play"], "left_anti")
        .distinct()
    )


def play_probability(quality: DataFrame, model: str = "base") -> DataFrame:
    """Per frame, the best tackler's summed quality, its probability and the label shown with it."""
    best = quality.groupBy(*CELL_FRAME).agg(
        strict(F.max("sum_quality"), "sum_quality").alias("max_sum")
    )
    share = F.bround(F.bround(tackle_probability("max_sum", model), 3) * 100, 1)
    number = F.regexp_replace(share.cast("string"), r"\.0$", "")
    return best.withColumns(
        {
            "probability": tackle_probability("max_sum", model),
            "label": F.concat(F.lit("Tackle Probability: "), number, F.lit("%")),
        }
    )
