"""Data drawn around a play: field lines and team colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardgrid.functions.text import height_yards
from yardgrid.operators.clean import PLAY


def play_direction(tracking: DataFrame) -> DataFrame:
    """Direction of each play."""
    return tracking.groupBy(*PLAY).agg(F.max("playDirection").alias("playDirection"))


def field_lines(plays: DataFrame, direction: DataFrame) -> DataFrame:
    """Line of scrimmage and first-down line of each play, on the recorded field."""
    left = F.col("playDirection") == "left"
    los = F.when(left, F.col("yardlineNumber") + 10).otherwise(110 - F.col("yardlineNumber"))
    ahead = F.when(left, -F.col("yardsToGo")).otherwise(F.col("yardsToGo"))
    return (
        plays.join(direction, PLAY)
        .withColumn("line_of_scrimmage", los)
        .withColumn("to_go_line", F.col("line_of_scrimmage") + ahead)
        .select(*PLAY, "playDirection", "line_of_scrimmage", "to_go_line")
    )


def team_colors(games: DataFrame, colors: DataFrame, diverge: bool = False) -> DataFrame:
    """First and second colours of both teams of each game.

    With ``diverge`` the visitors swap theirs when both first colours are of one family.
    """
    home = colors.select(
        F.col("teams").alias("homeTeamAbbr"),
        F.col("color1").alias("home_1"),
        F.col("color2").alias("home_2"),
        F.col("color1_family").alias("_home"),
    )
    away = colors.select(
        F.col("teams").alias("visitorTeamAbbr"),
        F.col("color1").alias("_one"),
        F.col("color2").alias("_two"),
        F.col("color1_family").alias("_away"),
    )
    swap = F.lit(diverge) & (F.col("_home") == F.col("_away"))
    return (
        games.join(home, "homeTeamAbbr")
        .join(away, "visitorTeamAbbr")
        .select(
            "gameId",
            "homeTeamAbbr",
            "visitorTeamAbbr",
            "home_1",
            "home_2",
            F.when(swap, F.col("_two")).otherwise(F.col("_one")).alias("away_1"),
            F.when(swap, F.col("_one")).otherwise(F.col("_two")).alias("away_2"),
        )
    )


def parse_height(players: DataFrame) -> DataFrame:
    """Players with the height in yards."""
    return players.select(
        "nflId", height_yards(F.col("height")).alias("height"), "weight", "position", "displayName"
    )
