"""The given tables read as tracking data.

Every tracking table is derived row by row from ``events`` (dense ids from 0), so all of them grow
with it. 22 consecutive events are one frame, 25 frames a play, 4 plays a game, 16 games a week.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_GAME = 2022000000


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _whole(text: str) -> Column:
    return F.expr(text)


def _play_serial(game: str = "gameId", play: str = "playId") -> Column:
    return (F.col(game) - FIRST_GAME) * 4 + F.col(play) - 1


@dataclass(frozen=True)
class Season:
    """The tracking tables derived from one folder of given tables."""

    spark: SparkSession
    folder: str

    @cached_property
    def events(self) -> DataFrame:
        """The rows everything is derived from, with the serial number of their play."""
        return load(self.spark, self.folder, "events").select(
            "event_id",
            "event_type",
            "value",
            "ts",
            "user_id",
            _whole("event_id div 550").alias("serial"),
        )

    @cached_property
    def _moves(self) -> DataFrame:
        frame = F.col("frameId")
        event = (
            F.when(frame == 1, "ball_snap")
            .when(
                frame == 5,
                F.when(F.col("serial") % 3 == 0, "handoff")
                .when(F.col("serial") % 3 == 1, "pass_outcome_caught")
                .otherwise("run"),
            )
            .when((frame == 12) & (F.col("serial") % 5 == 0), "lateral")
            .when(
                frame == 21,
                F.when(F.col("serial") % 8 == 7, "out_of_bounds")
                .when(F.col("serial") % 4 == 2, "touchdown")
                .otherwise("tackle"),
            )
        )
        numbered = self.events.select(
            _whole(f"{FIRST_GAME} + event_id div 2200").alias("gameId"),
            (F.col("serial") % 4 + 1).alias("playId"),
            _whole("cast((event_id div 22) % 25 + 1 as int)").alias("frameId"),
            (F.col("event_id") % 22 + 1).alias("nflId"),
            "serial",
            "event_id",
            "value",
            _whole("cast(1 + event_id div 35200 as int)").alias("week"),
        )
        return numbered.withColumn("event", event)

    @cached_property
    def tracking(self) -> DataFrame:
        """Frames of 22 players and the ball."""
        side = F.when(F.col("serial") % 2 == 0, "left").otherwise("right")
        shared = ["gameId", "playId", "frameId", "event", "week"]
        value = F.col("value")
        players = self._moves.select(
            *shared,
            "nflId",
            F.concat(F.lit("Player "), F.col("nflId").cast("string")).alias("displayName"),
            F.when(F.col("nflId") <= 11, "AAA").otherwise("BBB").alias("club"),
            side.alias("playDirection"),
            (10 + (value * 7.31) % 100).alias("x"),
            ((value * 3.17) % (160.0 / 3.0)).alias("y"),
            (value % 10).alias("s"),
            (value % 4).alias("a"),
            (value % 1).alias("dis"),
            ((F.col("event_id") * 53) % 360).cast("double").alias("o"),
            ((F.col("event_id") * 37) % 360).cast("double").alias("dir"),
        )
        ball = self._moves.filter(F.col("nflId") == 1).select(
            *shared,
            F.lit(None).cast("bigint").alias("nflId"),
            F.lit("football").alias("displayName"),
            F.lit("football").alias("club"),
            side.alias("playDirection"),
            (10 + (value * 1.93) % 100).alias("x"),
            ((value * 2.71) % (160.0 / 3.0)).alias("y"),
            (value % 7).alias("s"),
            (value % 3).alias("a"),
            (value % 1).alias("dis"),
            F.lit(None).cast("double").alias("o"),
            F.lit(None).cast("double").alias("dir"),
        )
        return players.unionByName(ball)

    @cached_property
    def _play_rows(self) -> DataFrame:
        return self._moves.select("gameId", "playId").distinct()

    @cached_property
    def plays(self) -> DataFrame:
        """One row per play."""
        n = _play_serial()
        return self._play_rows.select(
            "gameId",
            "playId",
            (1 + F.col("playId")).alias("ballCarrierId"),
            (n % 4 + 1).cast("int").alias("quarter"),
            (n % 4 + 1).cast("int").alias("down"),
            (n % 10 + 1).cast("int").alias("yardsToGo"),
            F.lit("AAA").alias("possessionTeam"),
            F.lit("BBB").alias("defensiveTeam"),
            F.concat((n % 15).cast("string"), F.lit(":30:00")).alias("gameClock"),
            (n * 7 % 49 + 1).cast("int").alias("yardlineNumber"),
            (n * 7 % 99 + 11).cast("int").alias("absoluteYardlineNumber"),
        )

    @cached_property
    def pbp(self) -> DataFrame:
        """Play-by-play flags."""
        n = _play_serial()
        rush = 1 - n % 2
        return self._play_rows.select(
            F.col("gameId").cast("string").alias("old_game_id"),
            F.col("playId").alias("play_id"),
            (n % 2).cast("int").alias("pass"),
            rush.cast("int").alias("rush"),
            F.when(n % 7 == 6, 1).otherwise(0).alias("sack"),
            F.when(n % 11 == 10, rush).otherwise(0).cast("int").alias("qb_scramble"),
            F.when(n % 2 == 1, "pass").otherwise("run").alias("play_type"),
            F.when(n % 13 == 12, 1).otherwise(0).alias("fumble"),
            F.lit("BBB").alias("defteam"),
        )

    @cached_property
    def tackles(self) -> DataFrame:
        """Records of the defenders who have one in the play."""
        n = _play_serial() + F.col("nflId")
        defenders = (
            self._moves.filter((F.col("nflId") >= 12) & (F.col("frameId") == 1))
            .select("gameId", "playId", "nflId")
            .distinct()
        )
        return defenders.select(
            "gameId",
            "playId",
            "nflId",
            F.when(n % 3 == 0, 1).otherwise(0).alias("tackle"),
            F.when(n % 5 == 1, 1).otherwise(0).alias("assist"),
            F.when(n % 3 == 1, 1).otherwise(0).alias("pff_missedTackle"),
        )

    @cached_property
    def players(self) -> DataFrame:
        """Build and position of every player that occurs."""
        n = F.col("nflId")
        position = (
            F.when(n % 3 == 0, "LB").when(n % 3 == 1, "DB").otherwise("DL")
        )
        return (
            self.events.select((F.col("event_id") % 22 + 1).alias("nflId"))
            .distinct()
            .select(
                "nflId",
                F.concat_ws("-", (5 + n % 2).cast("string"), (n % 12).cast("string")).alias("height"),
                (180 + 5 * n).cast("int").alias("weight"),
                position.alias("position"),
                F.concat(F.lit("Player "), n.cast("string")).alias("displayName"),
            )
        )

    @cached_property
    def rosters(self) -> DataFrame:
        """Roster rows; the id is text."""
        return self.players.select(
            F.col("nflId").cast("string").alias("gsis_it_id"),
            "position",
            F.when(F.col("nflId") <= 11, "AAA").otherwise("BBB").alias("team"),
            F.concat(F.lit("img/"), F.col("nflId").cast("string")).alias("headshot_url"),
        )

    @cached_property
    def games(self) -> DataFrame:
        """Games with their week and teams."""
        return self._moves.select("gameId", "week").distinct().select(
            "gameId",
            "week",
            F.when(F.col("gameId") % 2 == 0, "AAA").otherwise("BBB").alias("homeTeamAbbr"),
            F.when(F.col("gameId") % 2 == 0, "BBB").otherwise("AAA").alias("visitorTeamAbbr"),
        )

    @cached_property
    def colors(self) -> DataFrame:
        """Colours of the clubs that occur: the families agree, so colours may have to diverge."""
        clubs = self.events.select(
            F.when(F.col("event_id") % 22 < 11, "AAA").otherwise("BBB").alias("teams")
        ).distinct()
        return clubs.select(
            "teams",
            F.concat(F.lit("first "), F.col("teams")).alias("color1"),
            F.concat(F.lit("second "), F.col("teams")).alias("color2"),
            F.lit("red").alias("color1_family"),
        )

    @cached_property
    def signal(self) -> DataFrame:
        """Measurements: signal strength from the value, operator from the event type."""
        return self.events.select(
            (F.col("user_id") % 90).cast("double").alias("client_latitude"),
            (F.col("event_id") % 180).cast("double").alias("client_longitude"),
            F.col("event_type").alias("network_operator_name"),
            (-F.col("value")).alias("rsrp"),
            F.col("ts").alias("result_date"),
        )
