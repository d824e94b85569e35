"""Cleaning of tracking frames: which rows count, where they are, and their influence scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardgrid.functions.geometry import (
    TOP_SPEED,
    add_scales,
    add_velocity,
    distance,
    standardize,
)
from yardgrid.functions.nulls import any_of, choose

PLAY = ["gameId", "playId"]
FRAME = [*PLAY, "frameId"]
PLAYER_PLAY = [*PLAY, "nflId"]

# Events that put the ball into the carrier's hands.
INITIAL_EVENTS = ("handoff", "run", "lateral", "pass_outcome_caught")
INITIAL_WITHOUT_HANDOFF = ("run", "lateral", "pass_outcome_caught")
INITIAL_WITH_ARRIVAL = ("pass_arrived", "handoff", "run", "lateral")


def players_only(df: DataFrame) -> DataFrame:
    """Without the rows of the ball."""
    return df.filter(F.col("club") != "football")


def ball_only(df: DataFrame) -> DataFrame:
    """Only the rows of the ball."""
    return df.filter(F.col("club") == "football")


def _with_game_id(pbp: DataFrame) -> DataFrame:
    return pbp.withColumn("game_id", F.col("old_game_id").cast("bigint"))


def designed_plays(pbp: DataFrame) -> DataFrame:
    """Passes and planned runs, sacks left out; adds the numeric ``game_id``."""
    planned = (F.col("pass") == 1) | ((F.col("rush") == 1) & (F.col("qb_scramble") == 0))
    return _with_game_id(pbp.filter(planned & (F.col("sack") == 0)))


def broken_plays(pbp: DataFrame) -> DataFrame:
    """Scrambles and fumbles; adds the numeric ``game_id``."""
    return _with_game_id(pbp.filter((F.col("qb_scramble") == 1) | (F.col("fumble") == 1)))


def carrier_location(tracking: DataFrame, plays: DataFrame, standardized: bool = True) -> DataFrame:
    """Position of the ball carrier in every frame."""
    moving = standardize(tracking) if standardized else tracking
    carriers = plays.select(*PLAY, F.col("ballCarrierId").alias("nflId"))
    return moving.join(carriers, PLAYER_PLAY).select(
        *FRAME, F.col("x").alias("x_car"), F.col("y").alias("y_car")
    )


def carrier_profile(tracking: DataFrame, plays: DataFrame, players: DataFrame) -> DataFrame:
    """The carrier's kinematics with the situation of the play and the carrier's build."""
    carriers = plays.select(
        *PLAY,
        F.col("ballCarrierId").alias("nflId"),
        "quarter",
        "down",
        "yardsToGo",
        "gameClock",
        "yardlineNumber",
        "absoluteYardlineNumber",
    )
    build = players.select(
        "nflId",
        F.col("height").alias("height_car"),
        F.col("weight").alias("weight_car"),
        F.col("position").alias("position_car"),
    )
    return (
        tracking.join(carriers, PLAYER_PLAY)
        .join(build, "nflId", "left")
        .select(
            *FRAME,
            F.col("x").alias("x_car"),
            F.col("y").alias("y_car"),
            F.col("s").alias("s_car"),
            F.col("a").alias("a_car"),
            F.col("o").alias("o_car"),
            F.col("dir").alias("dir_car"),
            "height_car",
            "weight_car",
            "position_car",
            F.col("displayName").alias("name_car"),
            "quarter",
            "down",
            "yardsToGo",
            "gameClock",
            "yardlineNumber",
            "absoluteYardlineNumber",
        )
    )


def ball_location(tracking: DataFrame) -> DataFrame:
    """Recorded position of the ball in every frame."""
    return ball_only(tracking).select(*FRAME, F.col("x").alias("x_ball"), F.col("y").alias("y_ball"))


def add_distance(
    df: DataFrame,
    location: DataFrame,
    x: str = "x_car",
    y: str = "y_car",
    out: str = "distance_to_ball",
) -> DataFrame:
    """Distance to the located object of the same frame; null where it has no row."""
    return df.join(location, FRAME, "left").withColumn(
        out, distance(F.col("x"), F.col("y"), F.col(x), F.col(y))
    )


def is_initial(events: Sequence[str] = INITIAL_EVENTS) -> Column:
    """Whether the frame carries an initial event; unknown when it carries no event."""
    return choose(F.col("event").isin(list(events)), True, False)


def first_frames(df: DataFrame, events: Sequence[str], keys: Sequence[str], out: str) -> DataFrame:
    """First frame of each group that carries one of the events."""
    return (
        df.filter(any_of("event", events))
        .groupBy(*keys)
        .agg(F.min("frameId").alias(out))
    )


def match_player(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join on game, play and player, where the missing player id of the ball matches itself."""
    renamed = other.select(
        F.col("gameId").alias("_game"),
        F.col("playId").alias("_play"),
        F.col("nflId").alias("_player"),
        *[c for c in other.columns if c not in PLAYER_PLAY],
    )
    same = (
        (F.col("gameId") == F.col("_game"))
        & (F.col("playId") == F.col("_play"))
        & F.col("nflId").eqNullSafe(F.col("_player"))
    )
    return df.join(renamed, same, how).drop("_game", "_play", "_player")


def trim_from_initial(df: DataFrame, events: Sequence[str] = INITIAL_EVENTS) -> DataFrame:
    """Keep each player's frames from the first initial event on; groups without one go.

    The few event rows are reduced to one row per player and play and joined back, so no group
    is sorted and a hot group can be split by the adaptive join.
    """
    starts = first_frames(df, events, PLAYER_PLAY, "_start")
    return match_player(df, starts).filter(F.col("frameId") >= F.col("_start")).drop("_start")


def trim_until_tackle(df: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Keep each player's frames up to one frame after the first tackle; all without a tackle.

    ``frames`` numbers the frames when ``df`` has been trimmed already (both bounds count on the
    untrimmed group).
    """
    frames = df if frames is None else frames
    tackled = first_frames(frames, ["tackle"], PLAYER_PLAY, "_tackle")
    ends = (
        match_player(frames.select(*PLAYER_PLAY, "frameId"), tackled)
        .groupBy(*PLAYER_PLAY, "_tackle")
        .agg(F.min(F.when(F.col("frameId") > F.col("_tackle"), F.col("frameId"))).alias("_after"))
        .select(*PLAYER_PLAY, F.coalesce("_after", "_tackle").alias("_end"))
    )
    return (
        match_player(df, ends, "left")
        .filter(F.col("_end").isNull() | (F.col("frameId") <= F.col("_end")))
        .drop("_end")
    )


def plays_with_event(df: DataFrame, events: Sequence[str]) -> DataFrame:
    """The plays in which one of the events occurs."""
    return df.filter(any_of("event", events)).select(*PLAY).distinct()


def clean_tracking(
    tracking: DataFrame,
    plays: DataFrame,
    pbp: DataFrame,
    initial_events: Sequence[str] = INITIAL_EVENTS,
    vmax: float = TOP_SPEED,
    direction: str = "reference",
) -> DataFrame:
    """Tracking frames of designed plays from possession on, with distance, scales and centre.

    The rows are cut down first (designed plays, possession), then joined to the carrier.
    """
    kept = designed_plays(pbp).select(
        F.col("game_id").alias("gameId"),
        F.col("play_id").alias("playId"),
        "old_game_id",
        "pass",
        "rush",
        "sack",
        "qb_scramble",
        "play_type",
    )
    moving = trim_from_initial(players_only(tracking).join(kept, PLAY), initial_events)
    placed = add_velocity(standardize(moving), direction)
    # Carriers are looked for in the designed plays only.
    carried = plays.join(kept.select(*PLAY), PLAY, "left_semi")
    located = add_distance(placed, carrier_location(tracking, carried))
    return add_scales(located, vmax).withColumn("initial", is_initial(initial_events))


def clean_tracking_by_ball(
    tracking: DataFrame, pbp: DataFrame, vmax: float = 13.6
) -> DataFrame:
    """The first form of the cleaner: distance to the recorded ball, frames from the initial event
    to one frame after the tackle, ball rows kept."""
    kept = designed_plays(pbp).select(
        F.col("game_id").alias("gameId"), F.col("play_id").alias("playId"), "play_type"
    )
    all_frames = tracking.join(kept, PLAY)
    trimmed = trim_until_tackle(trim_from_initial(all_frames, INITIAL_WITH_ARRIVAL), all_frames)
    placed = add_velocity(standardize(trimmed))
    located = add_distance(placed, ball_location(tracking), "x_ball", "y_ball")
    return add_scales(located, vmax).withColumn("initial", is_initial(INITIAL_WITH_ARRIVAL))


def near_ball(df: DataFrame, reach: float = 6) -> DataFrame:
    """Players within ``reach`` yards of the carrier."""
    return df.filter(F.col("distance_to_ball") <= reach)


def near_defenders(clean: DataFrame, pbp: DataFrame, reach: float = 6) -> DataFrame:
    """Players of the defending team near the carrier, frame by frame."""
    defence = pbp.select(
        F.col("old_game_id").cast("bigint").alias("game"),
        F.col("play_id").alias("play"),
        F.col("defteam").alias("team"),
    )
    near = near_ball(clean, reach).select(
        F.col("gameId").alias("game"),
        F.col("playId").alias("play"),
        F.col("frameId").alias("frame"),
        F.col("nflId").alias("player"),
        F.col("club").alias("team"),
    )
    return near.join(defence, ["game", "play", "team"], "left_semi")


def frame_slice(
    df: DataFrame, game: int, play: int, frame: int | None = None, names: Sequence[str] = FRAME
) -> DataFrame:
    """The rows of one play, or of one frame of it."""
    condition = (F.col(names[0]) == int(game)) & (F.col(names[1]) == int(play))
    if frame is not None:
        condition &= F.col(names[2]) == int(frame)
    return df.filter(condition)


def find_frames(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a kinematic condition."""
    return df.filter(condition)


def at_least(df: DataFrame, column: str, floor: float) -> DataFrame:
    """Rows whose value reaches the floor."""
    return df.filter(F.col(column) >= floor)


def select_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """The columns from ``first`` to ``last`` in the table's order."""
    names = df.columns
    start, stop = names.index(first), names.index(last)
    return df.select(*names[start : stop + 1])
