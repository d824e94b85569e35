"""Spreading player-frames over the yard cells they influence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardgrid.functions.geometry import (
    GRID_X,
    GRID_Y,
    REACH,
    REACH_X,
    REACH_Y,
    add_foci,
    in_ellipse,
)
from yardgrid.session import fan_out

CELL_FRAME = ["game", "play", "frame"]
CELL = [*CELL_FRAME, "x", "y"]

_SHAPE = ["mu_x", "mu_y", "rad_dir", "scal_x", "scal_y"]
# What the cells of a strip share, next to the ends of the chord.
_SHARED = ("_mu", "_e0", "_e1", "_e2")
# Widening of the analytic chord before the exact test decides, in yards.
_SLACK = 1e-6


def player_frames(clean: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The columns of a cleaned frame that influence needs, under the names of the cell tables.

    Rows at exactly the top speed, whose short scale is zero (a singular covariance), are left
    out. Rows without a position, heading or carrier stay and spread to no cell.
    """
    return clean.filter((F.col("club") != "football") & (F.col("speed_ratio") != 1)).select(
        F.col("gameId").alias("game"),
        F.col("playId").alias("play"),
        F.col("frameId").alias("frame"),
        F.col("nflId").alias("player"),
        *keep,
        *_SHAPE,
    )


def _with(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns given as SQL expressions."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def _box(frames: DataFrame, k: int) -> DataFrame:
    """First and last yard of the axis-aligned search box, cut to the reachable field.

    A centre far off the field turns the bounds around; the yards between them count either way.
    """
    x_from = f"greatest(rint(mu_x) - rint(scal_x * {k}), {REACH_X[0]}D)"
    x_to = f"least(rint(mu_x) + rint(scal_x * {k}), {REACH_X[1]}D)"
    y_from = f"greatest(rint(mu_y) - ceil(scal_y * {k}), {REACH_Y[0]}D)"
    y_to = f"least(rint(mu_y) + ceil(scal_y * {k}), {REACH_Y[1]}D)"
    return _with(
        frames,
        _x_lo=f"least({x_from}, {x_to})",
        _x_hi=f"greatest({x_from}, {x_to})",
        _y_lo=f"least({y_from}, {y_to})",
        _y_hi=f"greatest({y_from}, {y_to})",
    )


def strips(frames: DataFrame, k: int = REACH, clip: bool = False) -> DataFrame:
    """One row per player-frame and field column ``x``, with the first and last yard in y and all
    that the cells of the column share. There is no shuffle.

    The foci ellipse with sum ``k*long`` has half axes ``a = k*long/2`` along the heading and
    ``b`` with ``b*b = a*a - 4*(long*long - short*short)``; its half width in x and, for a given
    x, its chord in y bound the cells without trying the whole box. The chord is widened a little
    (more where its root is ill-conditioned); the exact test of its end cells decides.

    With ``clip`` only cells within the row's ``_x_min`` .. ``_x_max`` and ``_y_min`` .. ``_y_max``
    are made.
    """
    long, short = "greatest(scal_x, scal_y)", "least(scal_x, scal_y)"
    boxed = _box(add_foci(frames), k)
    if clip:
        boxed = _with(
            boxed,
            _x_lo="greatest(_x_lo, _x_min)",
            _x_hi="least(_x_hi, _x_max)",
            _y_lo="greatest(_y_lo, _y_min)",
            _y_hi="least(_y_hi, _y_max)",
        )
    framed = _with(
        boxed,
        sin_dir="sin(rad_dir)",
        cos_dir="cos(rad_dir)",
        _aa=f"{long} * {long} * {k * k / 4.0}D",
        _bb=f"{long} * {long} * {k * k / 4.0}D - 4 * ({long} * {long} - {short} * {short})",
    )
    shaped = _with(
        framed,
        _half=f"sqrt(_aa * sin_dir * sin_dir + _bb * cos_dir * cos_dir) + {_SLACK}D",
        # Quadratic of the chord in y for an offset in x.
        _q2="cos_dir * cos_dir / _aa + sin_dir * sin_dir / _bb",
        _q1="sin_dir * cos_dir * (1 / _aa - 1 / _bb)",
        _q0="1 / (_aa * _bb)",
    )
    bounded = _with(
        shaped,
        _x_lo="int(greatest(_x_lo, ceil(mu_x - _half)))",
        _x_hi="CASE WHEN _half IS NOT NULL AND mu_y IS NOT NULL THEN int(least(_x_hi, floor(mu_x + _half))) END",
    )
    columns = _with(bounded, x="explode(CASE WHEN _x_lo <= _x_hi THEN sequence(_x_lo, _x_hi) END)")
    rooted = _with(
        columns,
        _root="sqrt(greatest(_q2 - (x - mu_x) * (x - mu_x) * _q0, 0D))",
        _middle="mu_y - (x - mu_x) * _q1 / _q2",
    )
    margin = f"_root / _q2 + {_SLACK}D + CASE WHEN _root < 1e-3D THEN 0.1D ELSE 0D END"
    chords = _with(
        rooted,
        _first=f"int(greatest(_y_lo, ceil(_middle - ({margin}))))",
        _last=f"int(least(_y_hi, floor(_middle + ({margin}))))",
        _reach=f"{k} * {long}",
        _near1="(x - f1_1) * (x - f1_1)",
        _near2="(x - f2_1) * (x - f2_1)",
        _along="(x - mu_x) * sin_dir / scal_x",
        _along_y="cos_dir / scal_x",
        _across="(x - mu_x) * cos_dir / scal_y",
        _across_y="-sin_dir / scal_y",
    )
    # Only the end cells can fail the exact test: their neighbours are a yard inside. Rows without
    # a shape are gone by now; saying so keeps null checks out of the cell code.
    sure = {
        "_from": f"CASE WHEN {_in_ellipse('_first')} THEN _first ELSE _first + 1 END",
        "_to": f"CASE WHEN {_in_ellipse('_last')} THEN _last ELSE _last - 1 END",
        "_mu": "mu_y",
        "_e0": "-0.5D * (_along * _along + _across * _across)",
        "_e1": "-(_along * _along_y + _across * _across_y)",
        "_e2": "-0.5D * (_along_y * _along_y + _across_y * _across_y)",
    }
    return _with(chords, **{name: f"coalesce({text}, 0)" for name, text in sure.items()})


def _in_ellipse(y: str) -> str:
    """Distances of a strip's cell ``y`` to the two foci add up to no more than the reach."""
    to_foci = (
        f"sqrt(_near1 + ({y} - f1_2) * ({y} - f1_2)) + sqrt(_near2 + ({y} - f2_2) * ({y} - f2_2))"
    )
    return f"{to_foci} <= _reach"


def _strip_influence(y: str) -> str:
    """Rotated bivariate normal at the cell ``y`` of a strip, divided by its value at the centre.

    The normaliser cancels, so the exponent is a quadratic of the offset in y.
    """
    return f"exp(_e0 + ({y} - _mu) * (_e1 + ({y} - _mu) * _e2))"


def spread(
    frames: DataFrame, keep: Sequence[str] = (), k: int = REACH, clip: bool = False
) -> DataFrame:
    """One row per cell of each player-frame's ellipse, with the influence there.

    Only the keys, ``keep``, the cell and ``influ`` leave the operator. There is no shuffle: the
    rows stay where their player-frame was.
    """
    cells = _with(strips(frames, k, clip), y="explode(CASE WHEN _from <= _to THEN sequence(_from, _to) END)")
    return cells.select(*CELL_FRAME, *keep, "x", "y", F.expr(_strip_influence("y")).alias("influ"))


def spread_columns(frames: DataFrame) -> DataFrame:
    """The cells of :func:`spread` by field column: game, play, frame, x, y, influs.

    ``influs`` has the influence of the yards from ``y`` on. The yards 0..54 of a column are one row;
    the few outside are a row each, so a row lies within a lane or beside all of them.
    """
    low, high = GRID_Y
    inside = _with(strips(frames), y=f"greatest(_from, {low})", _end=f"least(_to, {high})").filter("y <= _end")
    columns = inside.select(
        *CELL_FRAME, "x", "y", F.expr(f"transform(sequence(y, _end), at -> {_strip_influence('at')})").alias("influs")
    )
    cells = spread(leaves_lanes(frames).filter("strays")).filter(f"y NOT BETWEEN {low} AND {high}")
    return columns.unionByName(cells.select(*CELL, F.array("influ").alias("influs")))


def ellipse_window(k: int = REACH) -> dict[str, str]:
    """Bounds of a player-frame's ellipse in whole yards, as SQL expressions by name."""
    half = f"{k / 2.0}D * greatest(scal_x, scal_y)"
    return {
        "_x_min": f"floor(mu_x - {half})",
        "_x_max": f"ceil(mu_x + {half})",
        "_y_min": f"floor(mu_y - {half})",
        "_y_max": f"ceil(mu_y + {half})",
    }


def blank_strips(keys: DataFrame) -> DataFrame:
    """Strips without a cell for all columns of the dense grid."""
    columns = _with(keys, x=f"explode(sequence({GRID_X[0]}, {GRID_X[1]}))")
    return _with(columns, _from="1", _to="0", **{name: "0D" for name in _SHARED})


def lane_sums(
    strip_rows: DataFrame, keys: Sequence[str], weights: Sequence[str], floor: float | None = None
) -> DataFrame:
    """Weighted influence added up per key and field column, one sum for each yard in y.

    A strip is one row whatever its height, so a frame costs one hash update per player and
    column instead of one per cell. For each weight column ``_w_<name>`` the result has ``<name>``,
    the array of sums for y = 0..54; a yard nobody reaches (or only rows of null weight) is null.
    Influence below ``floor`` is left out.
    """
    lanes = range(GRID_Y[0], GRID_Y[1] + 1)

    def lane(name: str, y: int) -> str:
        value = _strip_influence(f"{y}D")
        taking_part = f"_from <= {y} AND _to >= {y} AND _w_{name} IS NOT NULL"
        if floor is not None:
            taking_part += f" AND {value} >= {floor}D"
        return f"sum(CASE WHEN {taking_part} THEN _w_{name} * {value} END)"

    sums = [F.expr(lane(n, y)).alias(f"{n}_{y}") for n in weights for y in lanes]
    arrays = [F.array(*[f"{n}_{y}" for y in lanes]).alias(n) for n in weights]
    return strip_rows.groupBy(*keys, "x").agg(*sums).select(*keys, "x", *arrays)


def unfold(sums: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per cell from the arrays of :func:`lane_sums`."""
    if len(names) == 1:
        return sums.select(*keys, "x", F.posexplode(names[0]).alias("y", names[0]))
    cells = sums.select(*keys, "x", F.posexplode(F.arrays_zip(*names)).alias("y", "_cell"))
    return cells.select(*keys, "x", "y", *[F.col("_cell")[n].alias(n) for n in names])


def leaves_lanes(frames: DataFrame, k: int = REACH) -> DataFrame:
    """Adds ``strays``: whether the search box holds yards outside 0..54 in y. That takes a centre
    far off the field, where the clipped bounds of the box turn around."""
    boxed = _with(_box(frames, k), strays=f"_y_lo < {GRID_Y[0]} OR _y_hi > {GRID_Y[1]}")
    return boxed.select(*frames.columns, "strays")


def reaches_a_cell(k: int = REACH) -> Column:
    """Whether the player-frame has at least one cell.

    A centre on the field always reaches its nearest cell. For the few off it the box is tried.
    Expects the columns of ``with_reach``.
    """
    near_x, near_y = F.rint("mu_x"), F.rint("mu_y")
    on_field = near_x.between(*REACH_X) & near_y.between(*REACH_Y)

    def column_hit(x: Column) -> Column:
        ys = F.sequence(F.col("_y_lo").cast("int"), F.col("_y_hi").cast("int"))
        return F.exists(ys, lambda y: in_ellipse(x, y, k))

    xs = F.sequence(F.col("_x_lo").cast("int"), F.col("_x_hi").cast("int"))
    unknown = F.col("scal_x").isNull() | F.col("mu_x").isNull() | F.col("mu_y").isNull()
    return F.when(unknown, False).when(on_field, True).otherwise(F.exists(xs, column_hit))


def with_reach(frames: DataFrame, k: int = REACH) -> DataFrame:
    """Adds ``reaches``: see :func:`reaches_a_cell`."""
    flagged = _box(add_foci(frames), k).withColumn("reaches", reaches_a_cell(k))
    return flagged.select(*frames.columns, "reaches")


def influence_by_play(clean: DataFrame) -> DataFrame:
    """The influence table partitioned by play: the narrow rows travel before they are spread."""
    frames = player_frames(clean).repartition(fan_out(clean.sparkSession), "game", "play")
    return spread(frames, ["player"]).select(*CELL_FRAME, "player", "x", "y", "influ")


def influence(clean: DataFrame) -> DataFrame:
    """The influence table: game, play, frame, player, x, y, influ."""
    return spread(player_frames(clean), ["player"]).select(*CELL_FRAME, "player", "x", "y", "influ")


def dense_cells(
    keys: DataFrame, x: tuple[int, int] = GRID_X, y: tuple[int, int] = GRID_Y
) -> DataFrame:
    """Every cell of the grid for every key row; a row generator, not a join."""
    return keys.withColumn("x", F.explode(F.sequence(F.lit(x[0]), F.lit(x[1])))).withColumn(
        "y", F.explode(F.sequence(F.lit(y[0]), F.lit(y[1])))
    )


def complete_grid(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fill: float,
    x: tuple[int, int] = GRID_X,
    y: tuple[int, int] = GRID_Y,
) -> DataFrame:
    """Add the grid cells a group lacks with ``fill``; rows off the grid stay.

    Without keys the grid is completed once for the whole table, as rows whose other columns are
    null. The missing cells come from an anti join on the full cell key, which spreads evenly.
    """
    keys = list(keys)
    spark = df.sparkSession
    groups = df.select(*keys).distinct() if keys else spark.range(1).select()
    dense = dense_cells(groups, x, y)
    present = df.select(*keys, "x", "y").distinct()
    # Cells are many more than Spark estimates from their player rows: no broadcast.
    missing = dense.join(present.hint("merge"), [*keys, "x", "y"], "left_anti")
    filled = df.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))
    return filled.unionByName(
        missing.withColumn(value, F.lit(fill)), allowMissingColumns=True
    )
