"""Iso-lines, sketches, exact strata, the club constraint and stopping with patience."""

import glob
import math
import os
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from yardgrid.operators import control, models, profile
from yardgrid.session import settle, shared_folder


def surface(spark, f, xs=range(12), ys=range(10)):
    return spark.createDataFrame([(1, 1, 1, x, y, float(f(x, y))) for x in xs for y in ys], "game bigint, play bigint, frame int, x int, y int, PC double")


def test_lines_around_a_peak_are_closed_rings(spark):
    df = surface(spark, lambda x, y: math.exp(-((x - 5.3) ** 2 + (y - 4.6) ** 2) / 6))
    segments = profile.contour_segments(df, "PC", [0.3, 0.6, 0.95, 2.0]).collect()
    assert {s.level for s in segments} == {0.3, 0.6, 0.95} or {s.level for s in segments} == {0.3, 0.6}
    for level in (0.3, 0.6):
        ends = {}
        for s in segments:
            if s.level == level:
                for p in ((s.x1, s.y1), (s.x2, s.y2)):
                    key = (round(p[0], 9), round(p[1], 9))
                    ends[key] = ends.get(key, 0) + 1
                    r = math.sqrt(-6 * math.log(level))
                    assert abs(math.dist(p, (5.3, 4.6)) - r) < 0.25
        assert ends and set(ends.values()) == {2}
    length = sum(math.dist((s.x1, s.y1), (s.x2, s.y2)) for s in segments if s.level == 0.3)
    assert abs(length - 2 * math.pi * math.sqrt(-6 * math.log(0.3))) < 0.5


def test_saddles_holes_and_flat_surfaces(spark):
    flat = surface(spark, lambda x, y: 0.5)
    assert profile.contour_segments(flat, "PC", [0.5, 0.4, 0.6]).count() == 0
    for middle, wanted in ((0.9, {("left", "top"), ("bottom", "right")}), (0.6, {("left", "bottom"), ("right", "top")})):
        corners = {(0, 0): middle, (1, 1): middle, (0, 1): 0.2, (1, 0): 0.2}
        found = profile.contour_segments(surface(spark, lambda x, y, c=corners: c[x, y], range(2), range(2)), "PC", [0.5]).collect()

        def side(x, y):
            return "left" if x == 0 else "right" if x == 1 else "bottom" if y == 0 else "top"

        assert {tuple(sorted((side(s.x1, s.y1), side(s.x2, s.y2)))) for s in found} == {tuple(sorted(w)) for w in wanted}
    slope = surface(spark, lambda x, y: x / 10)
    whole = profile.contour_segments(slope, "PC", [0.45]).count()
    holed = profile.contour_segments(slope.filter("not (x = 4 and y = 3)"), "PC", [0.45])
    assert whole == 9 and holed.count() == 7
    assert profile.contour_segments(slope.limit(0), "PC", [0.45]).count() == 0


def test_grid_of_quantiles_from_merged_sketches(spark):
    rng = random.Random(2)
    rows = [(w, b, rng.choice([rng.gauss(0, 1), 0.25, float(w)])) for w in (1, 2, 3) for b in (0, 1) for _ in range(4000)]
    rows += [(1, 0, None), (2, 1, float("nan"))]
    df = spark.createDataFrame(rows, "week int, bucket int, v double")
    values = sorted(v for *_, v in rows if v is not None and v == v)
    for n in (8, 100):
        grid = profile.qq_uniform_grid(profile.quantile_sketches(df, "v"), n).collect()
        assert [r.i for r in sorted(grid)] and len(grid) == n and {r.n for r in grid} == {len(values)}
        for r in grid:
            below = sum(v < r.value for v in values) / len(values)
            upto = sum(v <= r.value for v in values) / len(values)
            assert below - 0.01 <= r.uniform <= upto + 0.01
    assert profile.qq_uniform_grid(profile.quantile_sketches(df.limit(0), "v"), 5).count() == 0


def test_strata_have_exact_bounds(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(999)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v double")
    ordered = sorted(values)

    def quantile(p):
        at = p * (len(ordered) - 1)
        low = int(at)
        return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)

    bounds = [quantile(p) for p in (0.25, 0.5, 0.75)]
    split = models.stratified_split(df, "v", 0.8, ["id"], groups=5).collect()
    for stratum in range(4):
        rows = [r for r in split if sum(b < r.v for b in bounds) == stratum]
        assert sum(r.is_train for r in rows) == math.ceil(0.8 * len(rows))


def test_a_player_with_two_clubs_fails_the_job(spark):
    rows = [(1, 7, "AAA"), (1, 7, "AAA"), (2, 7, "BBB"), (1, 8, None), (1, 9, None), (1, 9, "CCC")]
    df = spark.createDataFrame(rows, "week int, nflId bigint, club string")
    found = control.single_clubs(df, ("week", "nflId"))
    assert {tuple(r) for r in found.collect()} == {(1, 7, "AAA"), (2, 7, "BBB"), (1, 8, None), (1, 9, "CCC")}
    with pytest.raises(Exception, match="more than one club for nflId=7: AAA, BBB"):
        control.single_clubs(df).collect()
    plan = control.single_clubs(df, ("week", "nflId"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_stopping_with_patience(spark):
    assert models.stop_round([3, 2, 1, 1, 1, 1], 3) == (3, 6)
    assert models.stop_round([3, 2, 1, 1, 1], 3) is None and models.stop_round([1], 1) is None
    assert models.stop_round([1, 2, 0.5, 2, 2], 2) == (3, 5)
    rng = random.Random(8)
    rows = [(1, 1, k, k % 7, k % 5, float(k % 3), float(k % 4), ((k % 7) + rng.gauss(0, 3)) / 10) for k in range(400)]
    df = spark.createDataFrame(rows, "game bigint, play bigint, frame int, x int, y int, x_car double, y_car double, PC double")
    split = models.pc_split(df)
    fit = models.fit_with_patience(split, most_rounds=12, patience=3, depth=3)
    assert fit.rounds == len(fit.errors) <= 12 and fit.model.getNumTrees == fit.best_round
    assert fit.errors[fit.best_round - 1] == min(fit.errors) and fit.rounds - fit.best_round <= 3
    # The error of the kept state, from its own predictions.
    held = models.evaluate_regressor(fit.model, split.filter("not is_train")).first()
    assert abs(held.mae - fit.errors[fit.best_round - 1]) < 1e-9
    loaded = models.score_regressor(fit.model, split).agg(F.count("prediction")).first()[0]
    assert loaded == len(rows)


def test_the_regressor_does_not_store_its_rows_again(spark):
    rng = random.Random(9)
    rows = []
    for k in range(9000):
        x, y, x_car, y_car = k % 7, k % 5, float(k % 3), float(k % 4)
        rows.append((x, y, x_car, y_car, 0.1 * x + 0.05 * y * x_car + rng.gauss(0, 0.2), k % 11 > 1))
    schema = "x int, y int, x_car double, y_car double, PC double, is_train boolean"
    split = settle(spark.createDataFrame(rows, schema))

    def stored():
        return sum(os.path.getsize(f) for f in glob.glob(f"{shared_folder(spark).removeprefix('file:')}/settled-*/*.parquet"))

    before = stored()
    model = models.fit_pc_regressor(split, iterations=6, depth=3)
    few = stored() - before
    many = settle(split.join(spark.range(30).select()))
    before = stored()
    again = models.fit_pc_regressor(many, iterations=6, depth=3)
    # 420 places in the grid, whatever the number of rows.
    assert stored() - before < 1.2 * few and again.getNumTrees == model.getNumTrees
    # Spark ML's own boosting of all rows, whose inputs have so few values that both cut everywhere.
    data = VectorAssembler(inputCols=list(models.INPUTS), outputCol="features").transform(split)
    theirs = GBTRegressor(
        featuresCol="features", labelCol="PC", lossType="absolute", validationIndicatorCol="held", maxIter=6, maxDepth=3, seed=12
    ).fit(data.withColumn("held", ~F.col("is_train")))
    assert model.getNumTrees == theirs.getNumTrees > 1 and list(model.treeWeights) == list(theirs.treeWeights)
    held = data.filter("not is_train")
    assert model.evaluateEachIteration(held, "absolute") == pytest.approx(theirs.evaluateEachIteration(held, "absolute"), rel=1e-9)
    with pytest.raises(Exception, match="an input of the regression is missing"):
        models.fit_pc_regressor(split.withColumn("y_car", F.expr("if(x = 3, null, y_car)")))
