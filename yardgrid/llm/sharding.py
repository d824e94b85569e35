"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 2^31 positions and a row belongs to the point that
follows its position. Rows arrive in the order of a second hash of their key; a row whose shard is
full goes on clockwise to the first shard with room. With no slack the capacities add up to the
number of rows, so counts differ by one at most.

All rows of one arc that arrive in one interval of the second hash form a cell. The number of cells
is a parameter (arcs x intervals), not a property of the data. The cells are counted by Spark, the
ring is walked once over the counts, and every row finds its shard from its rank in its cell. The
rows stay in DataFrame functions.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from yardgrid.llm.common import fresh

RING = 1 << 31
VNODES = 16
INTERVALS = 256

Piece = tuple[int, int, int, int, int, int]


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """The sorted (position, shard) points; a point depends only on its shard and number."""
    points = {}
    for shard in range(shards):
        for k in range(vnodes):
            digest = hashlib.md5(f"shard {shard} point {k}".encode()).digest()
            points.setdefault(int.from_bytes(digest[:4], "big") % RING, shard)
    return sorted(points.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may take; without slack they add up to ``rows``."""
    if slack <= 0:
        return [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return [int(-(-rows * (1 + slack) // shards))] * shards


def walk(
    counts: dict[tuple[int, int], int], points: list[tuple[int, int]], room: list[int]
) -> Iterator[Piece]:
    """Place the cells (interval, arc) in order of arrival.

    Yields (interval, arc, first rank, end rank, shard, first slot). A cell that meets a full
    shard is continued clockwise at the next shard that has room.
    """
    room, used = list(room), [0] * len(room)
    for interval, arc in sorted(counts):
        left, start, step = counts[interval, arc], 0, 0
        while left:
            shard = points[(arc + step) % len(points)][1]
            take = min(left, room[shard])
            if take:
                yield interval, arc, start, start + take, shard, used[shard]
                room[shard] -= take
                used[shard] += take
                start += take
                left -= take
            step += 1


def arc_of(position: int, points: list[tuple[int, int]]) -> int:
    """The number of the point that follows a position, clockwise."""
    return bisect.bisect_left([p for p, _ in points], position) % len(points)


def assign_shards(
    df: DataFrame, key: str, shards: int, slack: float = 0.0, vnodes: int = VNODES,
    intervals: int = INTERVALS, shard_col: str = "shard", slot_col: str = "slot",
) -> DataFrame:
    """``df`` with the shard of each row and its place in the shard, counted from 0.

    Rows with equal keys (null is a key too) share a cell and are placed one after the other,
    so a hot key is spread over shards like any other rows once its shard is full. An empty
    table stays empty. Other columns are kept; existing columns of the two names are replaced.
    """
    spark = df.sparkSession
    points = ring(shards, vnodes)
    df = df.drop(shard_col, slot_col)
    arc, interval, rank, order = (fresh(df, n) for n in ("_arc", "_interval", "_rank", "_order"))
    text = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    place = F.pmod(F.xxhash64(text, F.lit("place")), F.lit(RING))
    arrival = F.xxhash64(text, F.lit("arrival"))
    # The arc is the number of points before the position, found in a literal array.
    bounds = F.array(*[F.lit(p).cast("bigint") for p, _ in points])
    before = F.size(F.filter(bounds, lambda p: p < place)) % len(points)
    celled = df.withColumns({
        order: arrival,
        arc: before.cast("int"),
        interval: F.pmod(F.shiftrightunsigned(arrival, 32), F.lit(intervals)).cast("int"),
    })
    counts = {
        (row[0], row[1]): row[2]
        for row in celled.groupBy(interval, arc).agg(F.count(F.lit(1))).collect()
    }  # one row per cell, however many documents there are
    room = capacities(sum(counts.values()), shards, slack)
    pieces = list(walk(counts, points, room))
    # At most one piece for each cell and shard: (intervals x points + shards) rows in all.
    first, end, offset = (fresh(df, n) for n in ("_first", "_end", "_offset"))
    schema = (
        f"`{interval}_` int, `{arc}_` int, `{first}` bigint, `{end}` bigint,"
        f" `{shard_col}` int, `{offset}` bigint"
    )
    plan = F.broadcast(spark.createDataFrame(pieces, schema))
    in_cell = Window.partitionBy(interval, arc).orderBy(order, F.col(key))
    ranked = celled.withColumn(rank, F.row_number().over(in_cell).cast("bigint") - 1)
    placed = ranked.join(
        plan,
        (F.col(interval) == F.col(f"{interval}_"))
        & (F.col(arc) == F.col(f"{arc}_"))
        & (F.col(rank) >= F.col(first))
        & (F.col(rank) < F.col(end)),
    )
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col(shard_col),
        (F.col(offset) + F.col(rank) - F.col(first)).alias(slot_col),
    )
