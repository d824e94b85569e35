"""Grades of tacklers and the rankings made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yardgrid.functions.scoring import percent, tackle_probability

RATES = ("position_tackle", "tackle_pct", "technique")


def player_grades(
    contact: DataFrame, players: DataFrame, rosters: DataFrame, model: str = "new"
) -> DataFrame:
    """Per tackler: mean tackle probability, share of tackles made, their difference, contacts.

    Names come from ``players``; position, team and picture from ``rosters``, whose id is text.
    """
    summary = (
        contact.withColumn("_p", tackle_probability("sum_quality", model))
        .groupBy("tackler")
        .agg(
            F.avg("_p").alias("position_tackle"),
            F.avg("tackling").alias("tackle_pct"),
            F.count(F.lit(1)).alias("tackles"),
        )
        .withColumn("technique", F.col("tackle_pct") - F.col("position_tackle"))
    )
    names = players.select(F.col("nflId").alias("tackler"), "displayName")
    roster = rosters.select(
        F.col("gsis_it_id").alias("_id"), "position", "team", "headshot_url"
    )
    return (
        summary.join(names, "tackler", "left")
        .withColumn("_id", F.col("tackler").cast("string"))
        .join(roster, "_id", "left")
        .select(
            "tackler",
            "displayName",
            "position",
            "team",
            "headshot_url",
            "position_tackle",
            "tackle_pct",
            "technique",
            "tackles",
        )
    )


def leaderboard(
    grades: DataFrame,
    position: str | None = None,
    by: str = "technique",
    k: int = 10,
    ascending: bool = False,
    min_tackles: int = 11,
) -> DataFrame:
    """The first ``k`` tacklers by a grade, rates in percent with one decimal.

    One position is a sort with a limit; without a position every position gets its own top,
    cut per task before anything travels. Names break ties.
    """
    enough = grades.filter(F.col("tackles") >= min_tackles)
    order = [F.col(by).asc() if ascending else F.col(by).desc(), F.col("displayName").asc()]
    if position is not None:
        best = enough.filter(F.col("position") == position).orderBy(*order).limit(k)
    else:
        place = Window.partitionBy("position").orderBy(*order)
        best = enough.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
    return best.withColumns({name: percent(F.col(name)) for name in RATES})
