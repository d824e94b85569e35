"""Frames of potential tacklers: closest approach and what came of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardgrid.functions.nulls import choose, strict
from yardgrid.functions.text import play_frame_key
from yardgrid.operators.clean import (
    FRAME,
    INITIAL_EVENTS,
    INITIAL_WITHOUT_HANDOFF,
    PLAY,
    PLAYER_PLAY,
    add_distance,
    carrier_location,
    designed_plays,
    is_initial,
    plays_with_event,
    trim_from_initial,
)
from yardgrid.operators.order import running_total

# Events that end a play of interest.
FINAL_EVENTS = ("tackle", "touchdown")


def carrier_motion(clean: DataFrame, plays: DataFrame) -> DataFrame:
    """The carrier's speed, acceleration and orientations per frame, with the game clock."""
    roles = plays.select(*PLAY, F.col("ballCarrierId").alias("nflId"), "gameClock")
    return (
        clean.join(roles, PLAYER_PLAY)
        .select(
            *FRAME,
            F.col("nflId").alias("bc_id"),
            F.col("s").alias("s_car"),
            F.col("a").alias("a_car"),
            F.col("o").alias("o_car"),
            F.col("dir").alias("dir_car"),
            "gameClock",
        )
        .distinct()
    )


def closest_approach(df: DataFrame, distance: str = "distance_to_ball") -> DataFrame:
    """Smallest distance of each player in each play; null when one of the distances is missing."""
    return df.groupBy(*PLAYER_PLAY).agg(strict(F.min(distance), distance).alias("closest"))


def flag_closest(df: DataFrame, distance: str = "distance_to_ball") -> DataFrame:
    """``min_dist``: 1 on every frame at the smallest distance, else 0."""
    at_minimum = choose(F.col(distance) == F.col("closest"), 1, 0)
    return (
        df.join(closest_approach(df, distance), PLAYER_PLAY)
        .withColumn("min_dist", at_minimum)
        .drop("closest")
    )


def tackle_action(closest_only: bool = True) -> Column:
    """1 for a tackle or an assist, 0 for a missed tackle, else null.

    With ``closest_only`` all count at the closest approach; otherwise tackles and assists count on
    frames with the event ``tackle``.
    """
    hit = F.col("min_dist") == 1 if closest_only else F.col("event") == "tackle"
    return (
        F.when((F.col("tackle") == 1) & hit, 1)
        .when((F.col("assist") == 1) & hit, 1)
        .when((F.col("pff_missedTackle") == 1) & (F.col("min_dist") == 1), 0)
    )


def tackle_frames(
    clean: DataFrame,
    plays: DataFrame,
    tackles: DataFrame,
    only_tacklers: bool = True,
    initial_events: Sequence[str] = INITIAL_EVENTS,
) -> DataFrame:
    """Cleaned frames from possession on, of plays ending in a tackle or a touchdown.

    ``only_tacklers`` keeps the players with a tackle record; otherwise everybody is kept, the
    carrier included.
    """
    trimmed = trim_from_initial(clean, initial_events)
    ended = trimmed.join(plays_with_event(trimmed, FINAL_EVENTS), PLAY, "left_semi")
    records = tackles.select(*PLAYER_PLAY, "tackle", "assist", "pff_missedTackle")
    if only_tacklers:
        recorded = ended.join(records.filter(F.col("tackle").isNotNull()), PLAYER_PLAY)
    else:
        recorded = ended.join(records, PLAYER_PLAY, "left")
    moving = recorded.join(carrier_motion(clean, plays), FRAME, "left").withColumn(
        "play_frame_id", play_frame_key(F.col("playId"), F.col("frameId"))
    )
    flagged = flag_closest(moving)
    return flagged.withColumn("action", tackle_action())


def tackle_frames_by_event(
    tracking: DataFrame, plays: DataFrame, tackles: DataFrame, pbp: DataFrame
) -> DataFrame:
    """The earlier form on recorded positions: designed plays, no handoff among the initial events,
    tackles read from the event of the frame."""
    planned = designed_plays(pbp).select(
        F.col("game_id").alias("gameId"), F.col("play_id").alias("playId")
    )
    records = tackles.select(*PLAYER_PLAY, "tackle", "assist", "pff_missedTackle")
    recorded = tracking.join(planned, PLAY).join(records, PLAYER_PLAY, "left")
    trimmed = trim_from_initial(recorded, INITIAL_WITHOUT_HANDOFF)
    carrier = carrier_location(tracking, plays, standardized=False)
    located = add_distance(trimmed, carrier, out="distance_to_carrier")
    flagged = flag_closest(located, "distance_to_carrier")
    return flagged.withColumns(
        {"initial": is_initial(INITIAL_WITHOUT_HANDOFF), "action": tackle_action(False)}
    )


def covered_distance_play(tracking: DataFrame, out: str = "traveled_play") -> DataFrame:
    """Distance a player has covered in the play up to each frame."""
    return running_total(tracking, "dis", PLAYER_PLAY, ["frameId"], out)


def covered_distance_game(tracking: DataFrame, out: str = "traveled_game") -> DataFrame:
    """Distance a player has covered in the game up to each frame."""
    return running_total(tracking, "dis", ["gameId", "nflId"], ["playId", "frameId"], out)
