"""Pitch control: who holds each cell of the field, frame by frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardgrid.functions.geometry import GRID_X, GRID_Y
from yardgrid.functions.scoring import logistic
from yardgrid.operators.clean import PLAY
from yardgrid.operators.influence import (
    CELL,
    CELL_FRAME,
    blank_strips,
    complete_grid,
    ellipse_window,
    lane_sums,
    leaves_lanes,
    player_frames,
    spread,
    spread_columns,
    strips,
    unfold,
    with_reach,
)
from yardgrid.session import fan_out

# Rows of one frame above which its cells are summed over many tasks. A frame of a game has 22.
CROWD = 2_000


# -- sides ---------------------------------------------------------------------------------


def play_sides(plays: DataFrame) -> DataFrame:
    """Two rows per play: the club with the ball as ``off``, the other as ``def``."""
    off = plays.select(*_play_keys(), F.col("possessionTeam").alias("club"), F.lit("off").alias("team"))
    defence = plays.select(
        *_play_keys(), F.col("defensiveTeam").alias("club"), F.lit("def").alias("team")
    )
    return off.unionByName(defence)


def week_sides(clubs: DataFrame, games: DataFrame) -> DataFrame:
    """``home`` / ``away`` of each player of a week: nflId, side, team.

    ``clubs`` has the distinct (nflId, club) pairs of the week and ``games`` its games.
    """
    home = clubs.join(games, clubs["club"] == games["homeTeamAbbr"]).select(
        "nflId", F.lit("home").alias("club"), games["homeTeamAbbr"].alias("team")
    )
    away = clubs.join(games, clubs["club"] == games["visitorTeamAbbr"]).select(
        "nflId", F.lit("away").alias("club"), games["visitorTeamAbbr"].alias("team")
    )
    return home.unionByName(away)


def game_sides(clubs: DataFrame, games: DataFrame) -> DataFrame:
    """Like :func:`week_sides` for the players of single games: gameId, nflId, club, team."""
    side = F.when(F.col("club") == F.col("homeTeamAbbr"), "home").when(
        F.col("club") == F.col("visitorTeamAbbr"), "away"
    )
    return (
        clubs.join(games, "gameId")
        .withColumn("_side", side)
        .filter(F.col("_side").isNotNull())
        .select("gameId", "nflId", F.col("_side").alias("club"), F.col("club").alias("team"))
    )


def player_clubs(tracking: DataFrame) -> DataFrame:
    """Distinct (nflId, club) pairs."""
    return tracking.select("nflId", "club").distinct()


def single_clubs(tracking: DataFrame, by: Sequence[str] = ("nflId",)) -> DataFrame:
    """One row per player (or per ``by``, for instance week and player) with its club.

    A player with two clubs would double rows in a join on players, so the job fails and names the
    key. The test is part of the aggregation that finds the clubs; it costs no further pass. Rows
    without a club do not count; a key that has none keeps a null.
    """
    low, high = F.min("club"), F.max("club")
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in by])
    message = F.concat(F.lit("more than one club for "), name, F.lit(": "), low, F.lit(", "), high)
    club = F.when(high > low, F.raise_error(message)).otherwise(low)
    return tracking.groupBy(*by).agg(club.alias("club"))


def _play_keys() -> list[Column]:
    return [F.col("gameId").alias("game"), F.col("playId").alias("play")]


def carriers_of(plays: DataFrame) -> DataFrame:
    """game, play, player of each ball carrier."""
    return plays.select(*_play_keys(), F.col("ballCarrierId").alias("player"))


def framed_sides(clean: DataFrame, plays: DataFrame) -> DataFrame:
    """Player-frames ready to spread, with ``side`` (off, def or null) and ``carries``.

    Side and carrier are attached here, to the narrow rows, so nothing has to be joined to cells.
    """
    roles = plays.select(*PLAY, "possessionTeam", "defensiveTeam", "ballCarrierId")
    side = F.when(F.col("club") == F.col("defensiveTeam"), "def").when(
        F.col("club") == F.col("possessionTeam"), "off"
    )
    tagged = clean.join(roles, PLAY, "left").withColumns(
        {
            "side": side,
            "carries": F.coalesce(F.col("nflId") == F.col("ballCarrierId"), F.lit(False)),
        }
    )
    return player_frames(tagged, ["club", "side", "carries"])


def framed_home_away(clean: DataFrame, plays: DataFrame, games: DataFrame) -> DataFrame:
    """Like :func:`framed_sides` with the sides ``home`` and ``away`` of the game."""
    roles = plays.select(*PLAY, "ballCarrierId").join(
        games.select("gameId", "homeTeamAbbr", "visitorTeamAbbr"), "gameId", "left"
    )
    side = F.when(F.col("club") == F.col("homeTeamAbbr"), "home").when(
        F.col("club") == F.col("visitorTeamAbbr"), "away"
    )
    tagged = clean.join(roles, PLAY, "left").withColumns(
        {
            "side": side,
            "carries": F.coalesce(F.col("nflId") == F.col("ballCarrierId"), F.lit(False)),
        }
    )
    return player_frames(tagged, ["club", "side", "carries"])


# -- sums per cell -------------------------------------------------------------------------


def _by_crowding(frames: DataFrame, crowd: int) -> list[tuple[DataFrame, bool]]:
    """The rows of ordinary frames, brought together by frame, and those of crowded ones, where
    they lie.

    Both are always part of the plan; adaptive execution drops the second while it is empty. The
    frames are counted, and the crowded ones taken out, on the partitions by frame that the
    ordinary rows need anyhow.
    """
    placed = frames.repartition(fan_out(frames.sparkSession), *CELL_FRAME)
    sizes = placed.groupBy(*CELL_FRAME).agg(F.count(F.lit(1)).alias("rows"))
    crowded = sizes.filter(F.col("rows") > crowd).select(*CELL_FRAME)
    # The long side is on the left, where the adaptive skew join can cut it.
    calm = placed.join(crowded, CELL_FRAME, "left_anti")
    busy = frames.join(crowded, CELL_FRAME, "left_semi")
    return [(calm, True), (busy, False)]


def cell_totals(
    frames: DataFrame,
    weights: dict[str, Column],
    extra_keys: Sequence[str] = (),
    grid: bool = False,
    floor: float | None = None,
    crowd: int = CROWD,
) -> DataFrame:
    """Weighted sums of influence per cell, without shuffling cells.

    ``weights`` maps each result column to a weight computed from the columns of ``frames``; a row
    of null weight does not take part. Cells where no row takes part in any sum are left out,
    unless ``grid`` asks for the whole dense grid of every frame that has a cell.

    Ordinary frames travel as player rows, hashed by frame, and are spread and summed inside one
    task. Frames with more than ``crowd`` rows are spread where they lie, summed locally and
    merged by frame and column; their sums (at most one row per column) then join the others.
    The result is partitioned by frame, so frame-level work after it needs no exchange.

    ``frames`` is narrow and read several times, so it should be a stored table (``settle`` or a
    stage).
    """
    keys, names = [*CELL_FRAME, *extra_keys], list(weights)
    sums, strays = _column_totals(frames, weights, extra_keys, grid, floor, crowd)
    taking_part = F.lit(False)
    for name in names:
        taking_part = taking_part | F.col(name).isNotNull()
    if grid:
        taking_part = taking_part | F.col("x").between(*GRID_X)
    return unfold(sums, keys, names).filter(taking_part).unionByName(strays)


def _column_totals(
    frames: DataFrame,
    weights: dict[str, Column],
    extra_keys: Sequence[str] = (),
    grid: bool = False,
    floor: float | None = None,
    crowd: int = CROWD,
) -> tuple[DataFrame, DataFrame]:
    """The sums of :func:`cell_totals` as a row per field column, with an array for the yards in y,
    and cell by cell those of the few cells outside these yards."""
    partitions = fan_out(frames.sparkSession)
    keys, names = [*CELL_FRAME, *extra_keys], list(weights)

    def weighted(rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"_w_{name}": weight for name, weight in weights.items()})

    def columns(rows: DataFrame) -> DataFrame:
        """Sums per column of the rows that are together."""
        needed = strips(weighted(rows))
        if grid:
            reached = (
                with_reach(rows)
                .groupBy(*CELL_FRAME)
                .agg(F.max("reaches").alias("reached"))
                .filter("reached")
                .select(*CELL_FRAME)
            )
            needed = needed.unionByName(blank_strips(reached), allowMissingColumns=True)
        return lane_sums(needed, keys, names, floor)

    parts = []
    for rows, local in _by_crowding(frames, crowd):
        sums = columns(rows)
        parts.append(sums if local else sums.repartition(partitions, *CELL_FRAME))
    few = weighted(leaves_lanes(frames).filter("strays"))
    return reduce(DataFrame.unionByName, parts), _stray_cells(few, keys, names, floor)


def _stray_cells(
    few: DataFrame, keys: Sequence[str], names: Sequence[str], floor: float | None
) -> DataFrame:
    """The sums of the few cells outside the lanes, cell by cell."""
    extra = [name for name in keys if name not in CELL_FRAME]
    cells = spread(few, [*extra, *[f"_w_{name}" for name in names]])
    outside = cells.filter((F.col("y") < GRID_Y[0]) | (F.col("y") > GRID_Y[1]))
    if floor is not None:
        outside = _strong(outside, floor)
    sums = outside.groupBy(*keys, "x", "y").agg(
        *[F.sum(F.col(f"_w_{name}") * F.col("influ")).alias(name) for name in names]
    )
    known = F.lit(False)
    for name in names:
        known = known | F.col(name).isNotNull()
    partitions = fan_out(few.sparkSession)
    return sums.filter(known).repartition(partitions, *CELL_FRAME)


def signed_sum(plus: str, minus: str) -> Column:
    """Influence of one side less that of the other; rows of neither count for nobody."""
    return F.sum(signed_weight(plus, minus) * F.col("influ")).alias("net")


def signed_weight(plus: str, minus: str) -> Column:
    """1 for one side, -1 for the other, 0 for neither."""
    return F.when(F.col("side") == plus, 1.0).when(F.col("side") == minus, -1.0).otherwise(0.0)


# -- control surfaces ----------------------------------------------------------------------


def control_surface(
    frames: DataFrame, plus: str = "def", minus: str = "off", grid: bool = True, crowd: int = CROWD
) -> DataFrame:
    """Pitch control from player-frames: game, play, frame, x, y, PC.

    ``frames`` come from :func:`framed_sides` or :func:`framed_home_away`; the carrier's rows
    must be gone already (:func:`without_carrier`). An uncovered grid cell has 0.5, which is the
    logistic of no influence at all.
    """
    totals = cell_totals(frames, {"net": signed_weight(plus, minus)}, grid=grid, crowd=crowd)
    return totals.select(*CELL, logistic(F.coalesce("net", F.lit(0.0))).alias("PC"))


def control_columns(
    frames: DataFrame, plus: str = "def", minus: str = "off", crowd: int = CROWD
) -> DataFrame:
    """The cells of :func:`control_surface` by field column: game, play, frame, x, y, PCs.

    ``PCs`` has the control of the yards from ``y`` on, null where there is no cell. A column of the
    grid is one row; the few cells outside its yards are a row each. So a frame is stored, sorted and
    read as a hundred rows instead of its thousands of cells.
    """
    sums, strays = _column_totals(frames, {"net": signed_weight(plus, minus)}, grid=True, crowd=crowd)
    on_grid = F.col("x").between(*GRID_X)

    # One function over the array: an expression for each yard makes a method too long to be compiled.
    # The sums are named twice, so Spark keeps them apart from it and compiles the aggregation.
    whole = F.transform("net", lambda n: F.when(n.isNull(), 0.5).otherwise(logistic(n)))
    pcs = F.when(on_grid, whole).otherwise(F.transform("net", lambda n: logistic(n)))
    columns = sums.select(*CELL_FRAME, "x", F.lit(GRID_Y[0]).alias("y"), pcs.alias("PCs"))
    single = F.array(logistic(F.coalesce("net", F.lit(0.0))))
    return columns.unionByName(strays.select(*CELL, single.alias("PCs")))


def without_carrier(frames: DataFrame) -> DataFrame:
    """Player-frames of everybody but the ball carrier."""
    return frames.filter(~F.col("carries"))


def pitch_control(influence: DataFrame, clubs: DataFrame, plays: DataFrame) -> DataFrame:
    """Pitch control from a stored influence table.

    ``clubs`` holds one club for each player (:func:`single_clubs`). What a play says of its players
    is one row, which meets the cells by play. A table that is partitioned by play is tagged, summed
    column by column and completed where it lies.
    """
    signed = (
        play_sides(plays).withColumnRenamed("team", "side")
        .join(clubs.withColumnRenamed("nflId", "player"), "club")
        .withColumn("sign", signed_weight("def", "off"))
        .filter("player is not null")
        .groupBy("game", "play", "player").agg(F.sum("sign").alias("sign"))
        .groupBy("game", "play").agg(F.map_from_entries(F.collect_list(F.struct("player", "sign"))).alias("_signs"))
    )
    tagged = (
        influence.join(_carriers_by_play(plays), ["game", "play"], "left")
        .filter(~F.coalesce(F.array_contains("_carriers", F.col("player")), F.lit(False)))
        .join(_by_play(signed), ["game", "play"], "left")
    )
    sign = F.coalesce(F.try_element_at("_signs", F.col("player")), F.lit(0.0))
    part = F.coalesce(sign * F.col("influ"), F.lit(0.0))
    frames = tagged.select(*CELL_FRAME).distinct()
    return _summed_by_column(tagged.select(*CELL, part.alias("_part")), frames).select(
        *CELL, logistic(F.col("net")).alias("PC")
    )


def _by_play(df: DataFrame) -> DataFrame:
    """A table of one row per play, brought to the cells of the play while it is narrow."""
    return df.repartition(fan_out(df.sparkSession), "game", "play").hint("shuffle_hash")


def _carriers_by_play(plays: DataFrame) -> DataFrame:
    """The ball carriers of each play as one row."""
    carriers = carriers_of(plays).filter("player is not null")
    return _by_play(carriers.groupBy("game", "play").agg(F.collect_list("player").alias("_carriers")))


def _summed_by_column(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """Sums ``net`` of ``_part`` per cell, with 0 for the grid cells that ``frames`` lack.

    Yards in y are added up in bands as high as the grid, one row for each field column and band, so
    a task holds a hundred rows of a frame instead of its thousands of cells.
    """
    height = GRID_Y[1] - GRID_Y[0] + 1
    band = F.floor((F.col("y") - GRID_Y[0]) / height)
    placed = cells.select(
        *CELL_FRAME, "x", band.alias("_band"), (F.col("y") - GRID_Y[0] - band * height).alias("_lane"), "_part"
    )
    blank = frames.select(*CELL_FRAME, F.explode(F.sequence(F.lit(GRID_X[0]), F.lit(GRID_X[1]))).alias("x")).select(
        *CELL_FRAME, "x", F.lit(0).cast("bigint").alias("_band"), F.lit(None).cast("bigint").alias("_lane"),
        F.lit(None).cast("double").alias("_part"),
    )
    lanes = [F.sum(F.when(F.col("_lane") == k, F.col("_part"))).alias(f"_{k}") for k in range(height)]
    sums = placed.unionByName(blank).groupBy(*CELL_FRAME, "x", "_band").agg(*lanes)
    unfolded = sums.select(
        *CELL_FRAME, "x", "_band", F.posexplode(F.array(*[f"_{k}" for k in range(height)])).alias("_lane", "net")
    )
    on_grid = (F.col("_band") == 0) & F.col("x").between(*GRID_X)
    kept = unfolded.filter(F.col("net").isNotNull() | on_grid)
    y = (F.col("_band") * height + F.col("_lane") + GRID_Y[0]).cast("int")
    return kept.select(*CELL_FRAME, "x", y.alias("y"), F.coalesce("net", F.lit(0.0)).alias("net"))


def home_away_control(influence: DataFrame, sides: DataFrame) -> DataFrame:
    """First form of control from a stored influence table: home less away, carrier included.

    The grid is completed once for the whole table, so cells that no frame reaches appear once,
    without a frame.
    """
    named = sides.select(F.col("nflId").alias("player"), F.col("club").alias("side"))
    sums = (
        influence.join(named, "player", "left")
        .groupBy(*CELL)
        .agg(signed_sum("home", "away"))
    )
    surface = sums.select("game", "play", "x", "y", logistic(F.col("net")).alias("PC"))
    return complete_grid(surface, [], "PC", 0.5)


def _near_frames(frames: DataFrame, near: DataFrame) -> DataFrame:
    return without_carrier(frames).join(
        near.select(*CELL_FRAME, "player").distinct(), [*CELL_FRAME, "player"], "left_semi"
    )


def _strong(cells: DataFrame, floor: float) -> DataFrame:
    return cells.filter(F.col("influ") >= floor)


def capped_control(
    frames: DataFrame, near: DataFrame, floor: float = 0.01, crowd: int = CROWD
) -> DataFrame:
    """Added influence of the players near the carrier, at most 1 per cell.

    ``near`` lists (game, play, frame, player); weak influence below ``floor`` is left out.
    """
    totals = cell_totals(
        _near_frames(frames, near), {"total": F.lit(1.0)}, floor=floor, crowd=crowd
    )
    return totals.select(*CELL, F.least(F.col("total"), F.lit(1.0)).alias("PC"))


def individual_control(
    frames: DataFrame,
    near: DataFrame,
    defenders: DataFrame,
    floor: float = 0.01,
    crowd: int = CROWD,
) -> DataFrame:
    """Control of each near defender together with all near opponents, at most 1 per cell.

    The opponents of a frame are summed once per club; each defender then takes the other clubs'
    sums and adds the own cells, so players are never paired with players.
    """
    close = _near_frames(frames, near)
    by_club = cell_totals(
        close, {"part": F.lit(1.0)}, extra_keys=["club"], floor=floor, crowd=crowd
    )
    tagged = defenders.select(
        *CELL_FRAME, F.col("player").alias("defender"), F.col("team").alias("own")
    ).distinct()
    against = (
        by_club.join(tagged.hint("shuffle_hash"), CELL_FRAME)
        .filter(F.col("club") != F.col("own"))
        .select(*CELL, "defender", "part")
    )
    alone = close.join(
        defenders.select(*CELL_FRAME, "player").distinct(), [*CELL_FRAME, "player"], "left_semi"
    )
    # Brought together by frame while they are narrow, as the opponents' sums are.
    alone = alone.repartition(fan_out(frames.sparkSession), *CELL_FRAME)
    own = _strong(spread(alone, ["player"]), floor).select(
        *CELL, F.col("player").alias("defender"), F.col("influ").alias("part")
    )
    return (
        against.unionByName(own)
        .groupBy(*CELL, "defender")
        .agg(F.least(F.sum("part"), F.lit(1.0)).alias("PC"))
    )


# -- value ---------------------------------------------------------------------------------


def value_map(influence: DataFrame, plays: DataFrame) -> DataFrame:
    """The ball carrier's influence as ``value``, from a stored influence table.

    The carriers of a play are one row, so a table that is partitioned by play stays where it is.
    """
    met = influence.join(_carriers_by_play(plays), ["game", "play"]).filter(F.array_contains("_carriers", F.col("player")))
    # A carrier that a play names more than once counts as often.
    times = F.explode(F.filter("_carriers", lambda c: c == F.col("player")))
    return met.select(*CELL, F.col("influ").alias("value"), times.alias("_time")).drop("_time")


def value_surface(frames: DataFrame) -> DataFrame:
    """The ball carrier's influence as ``value``, from player-frames."""
    return spread(frames.filter(F.col("carries"))).withColumnRenamed("influ", "value")


def value_columns(frames: DataFrame) -> DataFrame:
    """The cells of :func:`value_surface` by field column: game, play, frame, x, y, values.

    ``values`` has the value of the yards from ``y`` on; see :func:`spread_columns`.
    """
    return spread_columns(frames.filter(F.col("carries"))).withColumnRenamed("influs", "values")


def control_value(frames: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The carrier's cells with ``value`` and ``PC``: both surfaces in one pass.

    Only the window of the carrier's ellipse is spread, which is a small part of the field, so the
    other players make few cells and no grid is needed. ``PC`` is null where the control surface
    has no row: off the grid where nobody else reaches, and in frames that hold nobody but the
    carrier. The result is partitioned by frame.
    """
    carrier = F.col("carries")
    bounds = ellipse_window()

    def windows(rows: DataFrame) -> DataFrame:
        return (
            with_reach(rows)
            .groupBy(*CELL_FRAME)
            .agg(
                *[
                    (F.min if name.endswith("min") else F.max)(F.when(carrier, F.expr(text))).alias(name)
                    for name, text in bounds.items()
                ],
                F.max(F.when(~carrier, F.col("reaches"))).alias("contested"),
            )
            .filter(F.col("_x_min").isNotNull())
        )

    partitions = fan_out(frames.sparkSession)
    influ = F.col("influ")

    def totals(rows: DataFrame, local: bool) -> DataFrame:
        weighted = rows.join(windows(rows), CELL_FRAME).withColumn("_w", F.when(~carrier, signed_weight("def", "off")))
        cells = spread(weighted, ["carries", "_w", "contested"], clip=True)
        sums = cells.groupBy(*CELL).agg(
            F.max(F.when(carrier, influ)).alias("value"),
            F.sum(F.col("_w") * influ).alias("net"),
            F.max("contested").alias("contested"),
        )
        return sums if local else sums.repartition(partitions, *CELL_FRAME)

    parts = [totals(rows, local) for rows, local in _by_crowding(frames, crowd)]
    summed = reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull())
    on_grid = F.col("x").between(*GRID_X) & F.col("y").between(*GRID_Y)
    uncovered = F.when(on_grid & F.coalesce("contested", F.lit(False)), 0.5)
    control = F.when(F.col("net").isNotNull(), logistic(F.col("net"))).otherwise(uncovered)
    return summed.select(*CELL, control.alias("PC"), "value")
