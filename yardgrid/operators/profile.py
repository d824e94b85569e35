"""Summaries behind the figures: events, lengths, distributions, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardgrid.functions.geometry import GRID_X, GRID_Y
from yardgrid.functions.nulls import join_alike
from yardgrid.functions.scoring import log_loss_term, tackle_probability
from yardgrid.operators.clean import PLAY
from yardgrid.operators.order import exact_quantiles, value_ranks

# Events that do not count as the first action of a play.
PRELIMINARY_EVENTS = (
    "ball_snap",
    "line_set",
    "shift",
    "snap_direct",
    "man_in_motion",
    "pass_forward",
    "play_action",
    "lateral",
    "run_pass_option",
)


def first_event_per_play(df: DataFrame) -> DataFrame:
    """The first counting event of each play, players and frames in ascending order."""
    counted = F.col("event").isNotNull() & ~F.col("event").isin(list(PRELIMINARY_EVENTS))
    return (
        df.filter(counted)
        .groupBy(*PLAY)
        .agg(F.min_by("event", F.struct("nflId", "frameId")).alias("first"))
    )


def first_events(df: DataFrame) -> DataFrame:
    """The distinct first events of all plays."""
    return first_event_per_play(df).select("first").distinct()


def play_length(df: DataFrame) -> DataFrame:
    """Number of different frames of each play."""
    frames = df.select(*PLAY, "frameId").distinct()
    return frames.groupBy(*PLAY).agg(F.count(F.lit(1)).alias("frames"))


def mean_by(df: DataFrame, value: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Mean of a column, per class."""
    return df.groupBy(*by).agg(F.avg(value).alias(out or f"mean_{value}"))


def _bin(value: Column, width: Column, boundary: Column) -> Column:
    """Number of the bin, open on the left and closed on the right."""
    return F.ceil((value - boundary) / width).cast("bigint")


def histogram(
    df: DataFrame,
    value: str,
    width: float | None = None,
    by: Sequence[str] = (),
    bins: int = 30,
) -> DataFrame:
    """Counts and density per bin: [by], bin, centre, n, density.

    With ``width`` the bins are centred on its multiples. Without, the range of each class is
    covered by ``bins`` bins, the first centred on its minimum. A missing class is a class.
    """
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    if width is not None:
        size, boundary = F.lit(float(width)), F.lit(width / 2.0)
    else:
        span = known.groupBy(*by).agg(
            F.struct(
                F.min(value).alias("lo"),
                ((F.max(value) - F.min(value)) / (bins - 1)).alias("w"),
            ).alias("_span")
        )
        known = join_alike(known, span, by) if by else known.withColumn("_span", span.scalar())
        size = F.col("_span.w")
        boundary = F.col("_span.lo") - size / 2
    placed = known.select(
        *by, _bin(F.col(value), size, boundary).alias("bin"), size.alias("_w"), boundary.alias("_b")
    )
    counts = placed.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_w").alias("_w"), F.first("_b").alias("_b")
    )
    if by:
        sizes = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
        counted = join_alike(counts, sizes, by)
    else:
        counted = counts.withColumn("_total", counts.agg(F.sum("n")).scalar())
    return counted.select(
        *by,
        "bin",
        (F.col("_b") + (F.col("bin") - 0.5) * F.col("_w")).alias("centre"),
        "n",
        (F.col("n") / (F.col("_total") * F.col("_w"))).alias("density"),
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 quartile ranges) and outliers per class."""
    by = list(by)
    quartiles = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    fenced = join_alike(
        df.filter(F.col(value).isNotNull()),
        quartiles.withColumn("_fence", 1.5 * (F.col("q3") - F.col("q1"))),
        by,
    )
    v = F.col(value)
    within = (v >= F.col("q1") - F.col("_fence")) & (v <= F.col("q3") + F.col("_fence"))
    return fenced.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(within, v)).alias("low"),
        F.max(F.when(within, v)).alias("high"),
        F.sum(F.when(within, 0).otherwise(1)).alias("outliers"),
    )


def qq_uniform(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sorted values against uniform quantiles, one row per distinct value.

    A value that occurs ``n`` times stands for the ``n`` points between ``first`` and ``last``.
    The i-th of n points is at (i - a) / (n + 1 - 2a) with a = 3/8 for n up to 10, else 1/2.
    """
    ranked = value_ranks(df, value, by)
    shift = F.when(F.col("total") <= 10, 0.375).otherwise(0.5)
    width = F.col("total") + 1 - 2 * shift
    return ranked.select(
        *by,
        value,
        "n",
        ((F.col("below") + 1 - shift) / width).alias("first"),
        ((F.col("below") + F.col("n") - shift) / width).alias("last"),
    )


SKETCH_K = 400
# Normalised rank error of a sketch with this k: 0.7 % at 99 % confidence.


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str] = ("week", "bucket"), k: int = SKETCH_K) -> DataFrame:
    """A mergeable quantile sketch of a column per part: ``by``, ``n`` and ``sketch``.

    Kept as a stage next to the rows it stands for; when a week is written again its sketches are
    replaced, and the others need no second look at their rows. A part without values has no sketch
    that counts (``n`` is 0).
    """
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch")
    )


def qq_uniform_grid(sketches: DataFrame, n: int, by: Sequence[str] = (), out: str = "value") -> DataFrame:
    """``n`` quantiles against uniform ones, from sketches that are merged on read.

    The i-th of the n points is at (i - a) / (n + 1 - 2a) with a = 3/8 for n up to 10, else 1/2, as
    in :func:`qq_uniform`; its value has that rank up to the rank error of the sketches. The result
    has n rows per group however many values there are.
    """
    shift = 0.375 if n <= 10 else 0.5
    positions = [(i - shift) / (n + 1 - 2 * shift) for i in range(1, n + 1)]
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    points = F.arrays_zip(
        F.lit(positions).alias("uniform"), F.kll_sketch_get_quantile_double("sketch", F.lit(positions)).alias(out)
    )
    return merged.filter("n > 0").select(*by, "n", F.posexplode(points).alias("i", "p")).select(
        *by, "n", (F.col("i") + 1).alias("i"), F.col("p.uniform"), F.col(f"p.{out}")
    )


def contour_segments(surface: DataFrame, value: str, levels: Sequence[float], by: Sequence[str] = ("game", "play", "frame")) -> DataFrame:
    """The iso-lines of a surface on the grid, as segments: ``by``, ``level``, x1, y1, x2, y2.

    Squares of four neighbouring cells are classified by the corners that reach the level; a segment
    joins the points where the level is met on the edges, by linear interpolation. Of the two ways
    through a saddle the mean of the corners decides. A column of the grid is one array and its
    right neighbour is the following row of the frame, so cells are neither joined nor moved from
    the task that holds the frame. Squares with a missing corner have no line; rows off the grid do
    not take part.
    """
    lanes = range(GRID_Y[0], GRID_Y[1] + 1)
    on_grid = F.col("x").between(*GRID_X) & F.col("y").between(*GRID_Y)
    columns = surface.filter(on_grid).groupBy(*by, "x").agg(
        F.array(*[F.max(F.when(F.col("y") == y, F.col(value))) for y in lanes]).alias("left")
    )
    following = Window.partitionBy(*by).orderBy("x")
    paired = columns.withColumns({"right": F.lead("left").over(following), "x_right": F.lead("x").over(following)})
    squares = paired.filter(F.col("x_right") == F.col("x") + 1).select(
        *by, "x", "left", "right", F.explode(F.sequence(F.lit(0), F.lit(len(lanes) - 2))).alias("_at")
    )
    corners = squares.select(
        *by, "x", (F.col("_at") + GRID_Y[0]).alias("y"),
        F.get("left", "_at").alias("a"), F.get("right", "_at").alias("b"),
        F.get("right", F.col("_at") + 1).alias("c"), F.get("left", F.col("_at") + 1).alias("d"),
    ).filter("a is not null and b is not null and c is not null and d is not null")
    # Levels that the square crosses: at least one corner below and one at it or above.
    low, high = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    crossed = F.filter(F.lit([float(v) for v in levels]), lambda v: (low < v) & (high >= v))
    # Most squares cross no level: they go by plain comparisons, before a function over the levels.
    any_level = F.lit(False)
    for v in levels:
        any_level |= (low < F.lit(float(v))) & (high >= F.lit(float(v)))
    crossing = corners.filter(any_level).withColumn("level", F.explode(crossed)).withColumn(
        "_case", F.expr("int(a >= level) + 2 * int(b >= level) + 4 * int(c >= level) + 8 * int(d >= level)")
    )
    # An edge whose corners are equal is not met; its quotient is null and not used.
    met = crossing.withColumns({
        "_bottom": F.expr("struct(x + try_divide(level - a, b - a) as x, double(y) as y)"),
        "_right": F.expr("struct(double(x + 1) as x, y + try_divide(level - b, c - b) as y)"),
        "_top": F.expr("struct(x + try_divide(level - d, c - d) as x, double(y + 1) as y)"),
        "_left": F.expr("struct(double(x) as x, y + try_divide(level - a, d - a) as y)"),
    })
    return _segments(met, by)


# The edges that a line joins, by the corners that reach the level (1 lower left, 2 lower
# right, 4 upper right, 8 upper left). At a saddle the second entry holds where the middle reaches it.
_JOINS = {
    1: (("left", "bottom"),), 2: (("bottom", "right"),), 3: (("left", "right"),), 4: (("right", "top"),),
    6: (("bottom", "top"),), 7: (("left", "top"),), 8: (("left", "top"),), 9: (("bottom", "top"),),
    11: (("right", "top"),), 12: (("left", "right"),), 13: (("bottom", "right"),), 14: (("left", "bottom"),),
}
_SADDLES = {
    5: ((("left", "bottom"), ("right", "top")), (("left", "top"), ("bottom", "right"))),
    10: ((("bottom", "right"), ("left", "top")), (("left", "bottom"), ("right", "top"))),
}


def _segments(met: DataFrame, by: Sequence[str]) -> DataFrame:
    def lines(joins: Sequence[tuple[str, str]]) -> str:
        return "array(" + ", ".join(f"struct(_{p} as p, _{q} as q)" for p, q in joins) + ")"

    cases = " ".join(f"WHEN {case} THEN {lines(joins)}" for case, joins in _JOINS.items())
    saddles = " ".join(
        f"WHEN {case} THEN if((a + b + c + d) / 4 >= level, {lines(high)}, {lines(low)})" for case, (low, high) in _SADDLES.items()
    )
    found = met.select(*by, "level", F.explode(F.expr(f"CASE _case {cases} {saddles} END")).alias("s"))
    return found.select(
        *by, "level", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2")
    )


def level_bins(
    df: DataFrame, value: str, breaks: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Number of rows between neighbouring breaks, as filled contours show them."""
    level = F.lit(None).cast("int")
    for i in range(len(breaks) - 1, 0, -1):
        inside = (F.col(value) >= breaks[i - 1]) & (F.col(value) < breaks[i])
        level = F.when(inside, i).otherwise(level)
    placed = df.withColumn("level", level).filter(F.col("level").isNotNull())
    return placed.groupBy(*by, "level").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, p: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: the four cells, accuracy, sensitivity and specificity (positive class 1)."""
    guess, truth = F.col(p) >= threshold, F.col(label) == 1

    def cell(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))

    return df.agg(
        cell(guess & truth).alias("tp"),
        cell(guess & ~truth).alias("fp"),
        cell(~guess & truth).alias("fn"),
        cell(~guess & ~truth).alias("tn"),
    ).withColumns(
        {
            "accuracy": F.try_divide(
                F.col("tp") + F.col("tn"),
                F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"),
            ),
            "sensitivity": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
            "specificity": F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")),
        }
    )


def log_loss(df: DataFrame, p: str, label: str) -> DataFrame:
    """Mean negative log likelihood."""
    return df.agg(F.avg(log_loss_term(F.col(p), F.col(label))).alias("log_loss"))


def calibration_bins(
    contact: DataFrame,
    width: float = 0.7,
    lo: float = 0,
    hi: float = 21,
    model: str = "new",
) -> DataFrame:
    """Per quality bin: successes, misses, observed rate and the curve at the centre."""
    number = F.floor((F.col("sum_quality") - lo) / width).cast("bigint")
    counted = (
        contact.filter(F.col("sum_quality").between(lo, hi))
        .groupBy(number.alias("bin"))
        .agg(
            F.sum(F.when(F.col("tackling") == 1, 1).otherwise(0)).alias("successes"),
            F.sum(F.when(F.col("tackling") == 0, 1).otherwise(0)).alias("misses"),
        )
        .withColumn("centre", lo + (F.col("bin") + 0.5) * width)
    )
    return counted.withColumns(
        {
            "observed": F.col("successes") / (F.col("successes") + F.col("misses")),
            "expected": tackle_probability("centre", model),
        }
    )
