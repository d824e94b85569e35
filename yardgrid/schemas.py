"""Explicit schemas of the input tables (ids are longs, flags are ints)."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_KINDS: dict[str, DataType] = {
    "BIGINT": LongType(),
    "INT": IntegerType(),
    "DOUBLE": DoubleType(),
    "STRING": StringType(),
    "TIMESTAMP": TimestampType(),
}


def schema(columns: str) -> StructType:
    """Schema from ``name KIND`` pairs; works without a running session."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _KINDS[kind]) for name, kind in pairs])


TRACKING = schema(
    "gameId BIGINT, playId BIGINT, nflId BIGINT, displayName STRING, frameId INT, time STRING, "
    "jerseyNumber INT, club STRING, playDirection STRING, x DOUBLE, y DOUBLE, s DOUBLE, a DOUBLE, "
    "dis DOUBLE, o DOUBLE, dir DOUBLE, event STRING"
)

PLAYS = schema(
    "gameId BIGINT, playId BIGINT, ballCarrierId BIGINT, playDescription STRING, quarter INT, down INT, "
    "yardsToGo INT, possessionTeam STRING, defensiveTeam STRING, gameClock STRING, yardlineNumber INT, "
    "absoluteYardlineNumber INT"
)

TACKLES = schema(
    "gameId BIGINT, playId BIGINT, nflId BIGINT, tackle INT, assist INT, pff_missedTackle INT"
)

PLAYERS = schema(
    "nflId BIGINT, height STRING, weight INT, position STRING, displayName STRING"
)

GAMES = schema(
    "gameId BIGINT, week INT, homeTeamAbbr STRING, visitorTeamAbbr STRING"
)

PLAY_BY_PLAY = schema(
    "old_game_id STRING, play_id BIGINT, pass INT, rush INT, sack INT, qb_scramble INT, play_type STRING, "
    "fumble INT, defteam STRING"
)

ROSTERS = schema(
    "gsis_it_id STRING, position STRING, team STRING, headshot_url STRING"
)

TEAM_COLORS = schema(
    "teams STRING, color1 STRING, color2 STRING, color1_family STRING"
)

SIGNAL = schema(
    "client_latitude DOUBLE, client_longitude DOUBLE, network_operator_name STRING, rsrp DOUBLE, "
    "result_date TIMESTAMP"
)
