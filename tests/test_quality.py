"""Ellipses joined by strips against every cell tested for every tackler."""

import math
import random

import pytest
from pyspark.sql import functions as F

from yardgrid.operators import quality

ELLIPSE = (
    "game bigint, play bigint, frame int, tackler bigint, min_dist int, distance double, f1_1 double, f1_2 double, "
    "f2_1 double, f2_2 double, scal_x double, scal_y double"
)


def ellipse(rng, frame, tackler):
    sx = rng.uniform(0.5, 8)
    sy = rng.choice([sx, rng.uniform(0.2, sx), -rng.uniform(0.1, sx)])
    t, x, y = rng.uniform(0, 7), rng.uniform(-5, 110), rng.uniform(-3, 58)
    c = math.sqrt((2 * max(sx, sy)) ** 2 - (2 * min(sx, sy)) ** 2)
    return (1, 1, frame, tackler, 0, 1.5, x - c * math.sin(t), y - c * math.cos(t), x + c * math.sin(t), y + c * math.cos(t), sx, sy)


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(4)
    rows = [ellipse(rng, frame, tackler) for frame in range(6) for tackler in range(12)]
    rows += rows[:3] * 3 + [(*rows[5][:6], *rows[6][6:]), (*rows[2][:6], *rows[7][6:]), (*rows[27][:6], *rows[27][6:]), (*rows[27][:6], *rows[28][6:]), (1, 1, 0, 99, 0, 1.0, None, None, None, None, None, None)]
    ellipses = spark.createDataFrame(rows, ELLIPSE)
    cells = spark.createDataFrame(
        [
            (1, 1, f, x, y, None if rng.random() < 0.00005 else rng.random(), rng.choice([rng.random(), 0.5]))
            for f in range(5) for x in range(121) for y in range(55) if rng.random() < (0.7 if f == 4 else 1.0)
        ],
        "game bigint, play bigint, frame int, x int, y int, PC double, value double",
    )
    return cells, ellipses


def test_strips_hold_the_cells_of_the_ellipses(given):
    cells, ellipses = given
    pairs = cells.join(ellipses.distinct(), quality.CELL_FRAME).filter(quality.in_ellipse(F.col("x"), F.col("y"), 5))
    strips = quality.ellipse_strips(ellipses.distinct(), 5).drop("x", "y_from", "y_to").columns
    held = cells.join(quality.ellipse_strips(ellipses.distinct(), 5), [*quality.CELL_FRAME, "x"]).filter("y between y_from and y_to")
    keys = ["x", "y", *strips]
    assert pairs.count() == held.count() > 5000
    assert pairs.select(*keys).exceptAll(held.select(*keys)).count() == 0


@pytest.mark.parametrize("k", [5, 4])
def test_equals_the_summary_over_all_pairs(given, k):
    cells, ellipses = given
    keys = [*quality.CELL_FRAME, "tackler"]
    wanted = {tuple(r[c] for c in keys): r for r in quality.quality_summary(cells, ellipses, k).collect()}
    found = {tuple(r[c] for c in keys): r for r in quality.quality_by_strips(cells, ellipses, k).collect()}
    assert set(found) == set(wanted) and len(wanted) > 40
    missing = 0
    for key, row in wanted.items():
        for name in ("sum_quality", "mean_quality", "median_quality", "max_quality", "min_dist", "distance"):
            a, b = row[name], found[key][name]
            missing += a is None
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (key, name, a, b)
    assert missing > 0


def test_ellipses_meet_columns_not_cells(given):
    cells, ellipses = given
    pairs = cells.join(ellipses.distinct(), quality.CELL_FRAME).count()
    columns = quality._product_lanes(cells).join(quality.ellipse_strips(ellipses.distinct()), [*quality.CELL_FRAME, "x"]).count()
    assert columns * 20 < pairs


def test_cells_by_frame_stay_where_they_are(spark, given):
    cells, ellipses = given
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = quality.quality_by_strips(cells.repartition(parts, *quality.CELL_FRAME), ellipses)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(game") == 3  # the cells' own, and the ellipses counted and placed
