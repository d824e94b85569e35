"""Connected components of a table of links, by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardgrid.session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); the label is the smallest node it can reach.

    In each round every node goes to the smallest node among itself and its neighbours, and on to
    where that one goes. Then the links are drawn between the nodes that were reached: those within
    one go, equal ones become one. So a group's links are read once or twice, not in every round.
    Two rounds leave at most half of the nodes. Each round is stored; the loop ends without links.
    """
    between = settle(_drawn(links))
    rounds = []
    while not between.isEmpty():
        back = between.select(F.col("b").alias("a"), F.col("a").alias("b"))
        nearest = between.union(back).groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
        rounds.append(tops := _tops(settle(nearest)))
        between = settle(_drawn(
            between.join(tops.toDF("a", "top_a"), "a").join(tops.toDF("b", "top_b"), "b")
            .select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))
        ))
    if not rounds:
        return between.toDF("node", "label")
    labels = rounds.pop()
    while rounds:
        labels = relabelled(rounds.pop(), labels)
    return settle(labels)


def relabelled(labels: DataFrame, above: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the labels that ``above`` gives to its labels; others stay."""
    return labels.join(above.toDF("label", "above"), "label", "left").select(
        "node", F.coalesce("above", "label").alias("label")
    )


def _drawn(links: DataFrame) -> DataFrame:
    """Each link between different nodes once, from the smaller to the larger."""
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends.filter("a < b").distinct()


def _tops(nearest: DataFrame) -> DataFrame:
    """(node, label) with the last node on the way from each node; ways halve in every round."""
    while True:
        onward = nearest.toDF("label", "beyond")
        moved = settle(nearest.join(onward, "label").select(
            "node", F.col("beyond").alias("label"), (F.col("beyond") < F.col("label")).alias("changed")
        ))
        nearest = moved.select("node", "label")
        if moved.filter("changed").isEmpty():
            return nearest
