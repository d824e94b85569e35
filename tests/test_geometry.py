import math

import pytest
from pyspark.sql import functions as F

from yardgrid.functions import geometry as g
from yardgrid.functions import nulls, scoring, text


def test_mirrored_play_equals_unmirrored(spark):
    rows = [("left", 30.0, 10.0), ("right", 90.0, 160 / 3 - 10.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "playDirection string, x double, y double")
    left, right, unknown = g.standardize(df).select("x", "y").collect()
    assert left.x == pytest.approx(right.x) == pytest.approx(80)
    assert left.y == pytest.approx(right.y)
    assert unknown.x is None and unknown.y is None


def test_radius(spark):
    df = spark.createDataFrame([(0.0,), (17.0,), (17.1,), (None,)], "d double")
    got = [r[0] for r in df.select(g.radius(F.col("d"))).collect()]
    assert got[0] == 4 and got[1] == pytest.approx(10, abs=1e-3) and got[2] == 10 and got[3] is None


def test_still_player_scales(spark):
    df = spark.createDataFrame(
        [(5.0, 6.0, 0.0, 0.0, 0.0)], "x double, y double, s double, rad_dir double, distance_to_ball double"
    )
    row = g.add_foci(g.add_scales(df)).first()
    assert (row.scal_x, row.scal_y, row.mu_x, row.mu_y) == (2, 2, 5, 6)
    assert (row.f1_1, row.f2_2) == (5, 6)


def test_corrected_direction_turns_right_plays(spark):
    df = spark.createDataFrame([(90.0, True), (90.0, False)], "dir double, ToLeft boolean")
    got = [r[0] for r in df.select(g.heading("corrected")).collect()]
    assert got == pytest.approx([math.pi / 2, 3 * math.pi / 2])
    with pytest.raises(ValueError):
        g.heading("other")


def test_raw_velocity_of_still_and_vertical(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 3.0), (90.0, 2.0)], "dir double, s double")
    still, vertical, flat = g.raw_velocity(df).collect()
    assert still.v_theta == 0
    assert vertical.v_theta == pytest.approx(math.pi / 2)
    assert flat.v_theta == pytest.approx(0, abs=1e-9)


def test_height_and_padding(spark):
    df = spark.createDataFrame([("6-4", 7), ("5-11", 42), (None, 1000), ("72", 1)], "h string, f int")
    rows = df.select(
        text.height_yards(F.col("h")).alias("h"), text.play_frame_key(F.lit(55), F.col("f")).alias("k")
    ).collect()
    assert rows[0].h == pytest.approx(6 / 3 + 4 / 36) and rows[1].h == pytest.approx(5 / 3 + 11 / 36)
    assert rows[2].h is None and rows[3].h is None
    assert [r.k for r in rows] == [55007, 55042, 551000, 55001]


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 2.0, 3.0), (2, 4.0, 5.0)], "g int, a double, b double")
    sums = {r.g: r.s for r in df.groupBy("g").agg(nulls.strict(F.sum("b"), "b").alias("s")).collect()}
    assert sums == {1: None, 2: 5.0}
    assert df.select(nulls.larger(F.col("a"), F.col("b"))).first()[0] is None
    assert nulls.zero_nulls(df).first().b == 0


def test_stored_curves(spark):
    df = spark.createDataFrame([(10.0,)], "q double")
    for name, (b0, b1) in scoring.STORED_CURVES.items():
        got = df.select(scoring.tackle_probability("q", name)).first()[0]
        assert got == pytest.approx(1 / (1 + math.exp(-(b0 + b1 * 10))))
