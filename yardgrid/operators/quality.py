"""Quality of control: pitch control times value inside each tackler's ellipse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardgrid.functions.geometry import GRID_X, GRID_Y, REACH, REACH_X, add_foci, in_ellipse
from yardgrid.functions.nulls import strict, surely
from yardgrid.operators.clean import PLAYER_PLAY
from yardgrid.operators.influence import CELL, CELL_FRAME
from yardgrid.operators.tackles import closest_approach
from yardgrid.session import fan_out


def approached(df: DataFrame, reach: float = 5) -> DataFrame:
    """Frames of the players who came within ``reach`` of the carrier in the play."""
    close = closest_approach(df).filter(F.col("closest") <= reach).select(*PLAYER_PLAY)
    return df.join(close, PLAYER_PLAY, "left_semi")


def tackler_ellipses(tackle_frames: DataFrame, reach: float = 5) -> DataFrame:
    """Foci and scales of the players who approached, one row per frame and tackler."""
    return add_foci(approached(tackle_frames, reach)).select(
        F.col("gameId").alias("game"),
        F.col("playId").alias("play"),
        F.col("frameId").alias("frame"),
        F.col("nflId").alias("tackler"),
        "min_dist",
        F.col("distance_to_ball").alias("distance"),
        "f1_1",
        "f1_2",
        "f2_1",
        "f2_2",
        "scal_x",
        "scal_y",
    )


def stored_control_value(control: DataFrame, value: DataFrame) -> DataFrame:
    """Value cells of the games at hand with their control, from the stored tables.

    Only control cells in the window of a frame's value cells take part. They meet by frame, so
    tables that are partitioned by frame stay where they are, and so does the result.
    """
    games = F.broadcast(control.select("game").distinct())  # a row per game; the cells stay
    carried = value.join(games, "game", "left_semi")
    window = carried.groupBy(*CELL_FRAME).agg(
        F.min("x").alias("_x_min"), F.max("x").alias("_x_max"), F.min("y").alias("_y_min"), F.max("y").alias("_y_max")
    )
    placed = window.repartition(fan_out(control.sparkSession), *CELL_FRAME).hint("shuffle_hash")
    near = control.join(placed, CELL_FRAME).filter("x between _x_min and _x_max and y between _y_min and _y_max")
    both = carried.withColumns({"PC": F.lit(None).cast("double"), "_carried": F.lit(True)}).unionByName(
        near.select(*CELL, "PC", F.lit(False).alias("_carried")), allowMissingColumns=True
    )
    met = both.withColumn("_controls", F.collect_list("PC").over(Window.partitionBy(*CELL))).filter("_carried")
    return met.select(*value.columns, F.explode_outer("_controls").alias("PC"))


def control_value_by_frame(control: DataFrame, value: DataFrame, games: DataFrame) -> DataFrame:
    """The result of :func:`stored_control_value` from tables that are bucketed by frame alike.

    Both are gathered per frame where they lie, so a frame meets a frame, on the keys of the
    buckets. On a complete grid the place of a cell in its frame is known; a cell that is not there
    is searched. ``games`` lists the games of the control table, as the index of the stage does.
    """
    width = GRID_Y[1] - GRID_Y[0] + 1
    surface = control.groupBy(*CELL_FRAME).agg(F.sort_array(F.collect_list(F.struct("x", "y", "PC"))).alias("_surface"))
    carried = (
        value.join(games.select("game").distinct(), "game", "left_semi")
        .groupBy(*CELL_FRAME).agg(F.collect_list(F.struct("x", "y", "value")).alias("_carried"))
    )
    place = f"get(_surface, (v.x - {GRID_X[0]}) * {width} + v.y - {GRID_Y[0]})"
    met = carried.join(surface.hint("merge"), CELL_FRAME, "left").withColumn("_cells", F.expr(
        f"""transform(_carried, v -> struct(v.x as x, v.y as y, v.value as value,
            if({place}.x = v.x and {place}.y = v.y, {place}.PC,
               get(filter(_surface, c -> c.x = v.x and c.y = v.y), 0).PC) as PC))"""
    ))
    return met.select(*CELL_FRAME, F.explode("_cells").alias("c")).select(*CELL_FRAME, "c.x", "c.y", "c.value", "c.PC")


def control_value_by_column(control: DataFrame, value: DataFrame, games: DataFrame) -> DataFrame:
    """The result of :func:`stored_control_value` from tables of field columns that are bucketed by
    frame alike (``control_columns``, ``value_columns``).

    The columns of a frame meet where they lie, on the keys of the buckets; a value column lies within
    one control column at most. ``games`` lists the games of the control table, as the index of the
    stage does.
    """
    carried = value.join(games.select("game").distinct(), "game", "left_semi").alias("v")
    surface = control.hint("merge").alias("c")
    met = [F.col(f"v.{k}") == F.col(f"c.{k}") for k in CELL_FRAME]
    # As bounds, so that the frame alone is the key of the join and fits the buckets.
    same_column = F.expr("v.x >= c.x and v.x <= c.x and v.y >= c.y and v.y < c.y + size(c.PCs)")
    both = carried.join(surface, reduce(Column.__and__, met) & same_column, "left")
    cells = both.select(
        *[f"v.{k}" for k in CELL_FRAME], "v.x", F.col("v.y").alias("_y"), F.col("c.y").alias("_first"), "c.PCs",
        F.posexplode("v.values").alias("_i", "value"),
    )
    return cells.select(
        *CELL_FRAME, "x", F.expr("_y + _i").alias("y"), "value", F.expr("get(PCs, _y + _i - _first)").alias("PC")
    )


def quality_summary(
    cells: DataFrame, ellipses: DataFrame, k: int = REACH, partitions: int | None = None
) -> DataFrame:
    """Sum, mean, median and maximum of ``PC * value`` per frame and tackler.

    A missing control makes the summary missing. ``cells`` that are already partitioned by frame
    (see ``control_value``) stay where they are: only the ellipses travel, copies of one ellipse as
    a single row with its count. ``partitions`` is the number of the cells' partitions, where it is
    not that of the session.
    """
    partitions = partitions or fan_out(cells.sparkSession)
    counted = ellipses.groupBy(*ellipses.columns).agg(F.count(F.lit(1)).alias("copies"))
    # The build side is named: Spark's estimate of spread cells misses their growth and could
    # have it broadcast them.
    placed = counted.repartition(partitions, *CELL_FRAME).hint("shuffle_hash")
    inside = cells.join(placed, CELL_FRAME).filter(surely(in_ellipse(F.col("x"), F.col("y"), k)))
    quality, copies = F.col("quality"), F.col("copies")
    graded = inside.withColumn("quality", F.col("PC") * F.col("value"))
    return graded.groupBy(*CELL_FRAME, "tackler").agg(
        strict(F.sum(quality * copies), quality).alias("sum_quality"),
        strict(F.sum(quality * copies) / F.sum(copies), quality).alias("mean_quality"),
        strict(F.percentile(quality, 0.5, copies), quality).alias("median_quality"),
        strict(F.max(quality), quality).alias("max_quality"),
        F.max("min_dist").alias("min_dist"),
        F.max("distance").alias("distance"),
    )


# Distance by which analytic ends are widened before the exact test decides, in yards.
_SLACK = 1e-6


def _add(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({f"_{name}": F.expr(text) for name, text in columns.items()})


def _columns_reached(ellipses: DataFrame, k: float) -> DataFrame:
    """The ellipses with the shape of their chords and the field columns they reach, ``_lo`` to ``_hi``.

    An ellipse is the set of points whose distances to the foci add up to ``k`` times the long scale;
    its half axes along and across the line of the foci follow from that.
    """
    shaped = _add(
        ellipses, reach=f"{float(k)}D * greatest(scal_x, scal_y)", cx="(f1_1 + f2_1) / 2", cy="(f1_2 + f2_2) / 2",
        c="sqrt(pow(f2_1 - f1_1, 2) + pow(f2_2 - f1_2, 2)) / 2",
    ).filter("scal_x is not null and scal_y is not null and _c < _reach / 2")
    axes = _add(
        shaped, aa="_reach * _reach / 4", bb="_reach * _reach / 4 - _c * _c",
        ux="CASE WHEN _c > 0 THEN (f2_1 - f1_1) / (2 * _c) ELSE 1D END",
        uy="CASE WHEN _c > 0 THEN (f2_2 - f1_2) / (2 * _c) ELSE 0D END",
    )
    spans = _add(
        axes, half=f"sqrt(_aa * _ux * _ux + _bb * _uy * _uy) + {_SLACK}D", q2="_uy * _uy / _aa + _ux * _ux / _bb",
        q1="_ux * _uy * (1 / _aa - 1 / _bb)",
    )
    return _add(
        spans, lo=f"int(greatest(ceil(_cx - _half), {REACH_X[0]}))", hi=f"int(least(floor(_cx + _half), {REACH_X[1]}))"
    )


def _with_chords(columns: DataFrame) -> DataFrame:
    """Adds ``y_from`` and ``y_to``, the yards in y that an ellipse has in the column ``x``; columns
    without one go. The analytic ends are widened a little and then tested exactly."""

    def tested(y: str) -> str:
        near = f"sqrt(pow(x - f1_1, 2) + pow({y} - f1_2, 2)) + sqrt(pow(x - f2_1, 2) + pow({y} - f2_2, 2))"
        return f"{near} <= _reach"

    chords = _add(
        columns, root="sqrt(greatest(_q2 - pow(x - _cx, 2) / (_aa * _bb), 0D))", middle="_cy - (x - _cx) * _q1 / _q2"
    )
    margin = f"_root / _q2 + {_SLACK}D + CASE WHEN _root < 1e-3D THEN 0.1D ELSE 0D END"
    ends = _add(chords, first=f"int(ceil(_middle - ({margin})))", last=f"int(floor(_middle + ({margin})))")
    return ends.withColumns({
        "y_from": F.expr(f"CASE WHEN {tested('_first')} THEN _first ELSE _first + 1 END"),
        "y_to": F.expr(f"CASE WHEN {tested('_last')} THEN _last ELSE _last - 1 END"),
    }).filter("y_from <= y_to")


def ellipse_strips(ellipses: DataFrame, k: float = REACH) -> DataFrame:
    """One row per ellipse and field column ``x`` it reaches, with its first and last yard in y."""
    reached = _columns_reached(ellipses, k)
    columns = reached.withColumn("x", F.explode(F.expr("CASE WHEN _lo <= _hi THEN sequence(_lo, _hi) END")))
    return _with_chords(columns).select(*ellipses.columns, "x", "y_from", "y_to")


def _product_lanes(cells: DataFrame) -> DataFrame:
    """Per frame and column the cells in order of y: ``ys`` and their products ``qs``. Cells stay in
    the task that holds their frame."""
    product = F.struct("y", (F.col("PC") * F.col("value")).alias("q"))
    columns = cells.groupBy(*CELL_FRAME, "x").agg(F.sort_array(F.collect_list(product)).alias("_cells"))
    return columns.select(*CELL_FRAME, "x", F.col("_cells")["y"].alias("ys"), F.col("_cells")["q"].alias("qs"))


def quality_by_strips(cells: DataFrame, ellipses: DataFrame, k: float = REACH) -> DataFrame:
    """The result of :func:`quality_summary`, with ellipses joined column by column.

    An ellipse meets the rows of field columns, not the cells of its frame; the cells inside it are
    a slice of such a row. Both sides are brought together by frame before they
    grow: cells where they are, ellipses as narrow rows.
    """
    partitions = fan_out(cells.sparkSession)
    counted = ellipses.groupBy(*ellipses.columns).agg(F.count(F.lit(1)).alias("copies"))
    reached = _columns_reached(counted.repartition(partitions, *CELL_FRAME), k).hint("shuffle_hash")
    met = _with_chords(_product_lanes(cells).join(reached, CELL_FRAME).filter("x between _lo and _hi"))
    # Cells of the column before the chord and up to its end; columns without holes need no search.
    whole = "size(ys) = element_at(ys, -1) - ys[0] + 1"
    placed = met.withColumns({
        "_i": F.expr(f"if({whole}, least(greatest(y_from - ys[0], 0), size(ys)), size(filter(ys, y -> y < y_from)))"),
        "_j": F.expr(f"if({whole}, greatest(least(y_to - ys[0] + 1, size(ys)), 0), size(filter(ys, y -> y <= y_to)))"),
    }).filter("_j > _i")
    grouped = (
        placed.select(
            *CELL_FRAME, "tackler", "min_dist", "distance",
            F.struct("copies", F.expr("slice(qs, _i + 1, _j - _i)").alias("qs")).alias("_slice"),
        )
        .groupBy(*CELL_FRAME, "tackler")
        .agg(
            F.collect_list("_slice").alias("_slices"), F.max("min_dist").alias("min_dist"), F.max("distance").alias("distance"),
        )
        .withColumn("_qs", F.sort_array(F.flatten(F.col("_slices")["qs"])))
        # Where all ellipses of a tackler occur equally often, their number changes no quantile or mean.
        .withColumn("_even", F.expr("array_min(_slices.copies) = array_max(_slices.copies)"))
        .withColumn("_weighted", F.expr("""if(_even, null, array_sort(flatten(
            transform(_slices, s -> transform(s.qs, q -> struct(q, s.copies as copies))))))"""))
        .withColumn("_n", F.expr("if(_even, size(_qs), aggregate(_weighted, 0L, (n, e) -> n + e.copies))"))
    )
    # The middle of products that count differently: one pass in their order.
    middle = """aggregate(_weighted, named_struct('seen', 0L, 'lo', cast(null as double), 'hi', cast(null as double)),
        (s, e) -> named_struct('seen', s.seen + e.copies,
          'lo', if(s.lo is null and s.seen + e.copies > (_n - 1) div 2, e.q, s.lo),
          'hi', if(s.hi is null and s.seen + e.copies > _n div 2, e.q, s.hi)),
        s -> (s.lo + s.hi) / 2)"""
    results = {
        "sum_quality": """if(_even, aggregate(_qs, 0D, (a, q) -> a + q) * _slices[0].copies,
            aggregate(_weighted, 0D, (a, e) -> a + e.q * e.copies))""",
        "mean_quality": "if(_even, aggregate(_qs, 0D, (a, q) -> a + q), aggregate(_weighted, 0D, (a, e) -> a + e.q * e.copies)) / _n",
        "median_quality": f"if(_even, (_qs[int((_n - 1) div 2)] + _qs[int(_n div 2)]) / 2, {middle})",
        "max_quality": "element_at(_qs, -1)",
    }
    # Missing products come first in the order; one makes the summary missing.
    return grouped.select(
        *CELL_FRAME, "tackler",
        *[F.when(F.expr("_qs[0] is not null"), F.expr(text)).alias(name) for name, text in results.items()],
        "min_dist", "distance",
    )


def frame_tackle_prob(cells: DataFrame, ellipses: DataFrame, k: int = 4) -> DataFrame:
    """Control times value added up per frame and tackler inside the smaller ellipse."""
    placed = ellipses.hint("shuffle_hash")
    inside = cells.join(placed, CELL_FRAME).filter(surely(in_ellipse(F.col("x"), F.col("y"), k)))
    product = F.col("PC") * F.col("value")
    return inside.groupBy(*CELL_FRAME, "tackler").agg(strict(F.sum(product), product).alias("prob"))
