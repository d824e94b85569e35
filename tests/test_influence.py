import random

import pytest
from pyspark.sql import functions as F

from tests import field
from yardgrid.operators import influence as inf

KEYS = ["game", "play", "frame"]


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        speed = rng.choice([0, rng.uniform(0, 9), rng.uniform(9, 14.9), rng.uniform(15.1, 20)])
        rows.append(
            field.clean_row(
                i, "AAA", rng.uniform(-9, 112), rng.uniform(-9, 62), speed, rng.uniform(0, 360),
                rng.uniform(0, 25), frame=i % 7,
            )
        )
    return rows


def shapes(rows):
    names = ("rad_dir", "scal_x", "scal_y", "mu_x", "mu_y")
    at = [field.CLEAN.split(", ").index(f"{n} double") for n in names]
    return {r[3]: dict(zip(names, (r[i] for i in at))) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_equal_matrix_form(spark, seed):
    rows = random_rows(40, seed)
    got = {}
    for r in inf.influence(field.clean_frame(spark, rows)).collect():
        got.setdefault(r.player, {})[(r.x, r.y)] = r.influ
    for player, f in shapes(rows).items():
        wanted = field.cells(f)
        assert got.get(player, {}).keys() == wanted.keys()
        for cell, value in wanted.items():
            assert got[player][cell] == pytest.approx(value, abs=1e-9)


def test_far_off_the_field_counts_down(spark):
    rows = [field.clean_row(1, "AAA", 50, -14, 0.0, 0, 0.0), field.clean_row(2, "AAA", 50, 70, 18, 0, 3.0)]
    got = {(r.player, r.x, r.y) for r in inf.influence(field.clean_frame(spark, rows)).collect()}
    wanted = {(p, x, y) for p, f in shapes(rows).items() for x, y in field.cells(f)}
    assert got == wanted


def test_top_speed_and_unknown_rows_have_no_cells(spark):
    rows = [field.clean_row(1, "AAA", 50, 20, 15.0, 30, 4), field.clean_row(2, "AAA", 50, 20, 3.0, 30, 4)]
    clean = field.clean_frame(spark, rows).withColumn(
        "scal_x", F.when(F.col("nflId") != 2, F.col("scal_x"))
    ).withColumn("scal_y", F.when(F.col("nflId") != 2, F.col("scal_y")))
    assert inf.influence(clean).count() == 0


def test_influence_is_one_at_the_centre(spark):
    rows = [field.clean_row(1, "AAA", 50, 20, 0.0, 0, 0.0)]
    got = {(r.x, r.y): r.influ for r in inf.influence(field.clean_frame(spark, rows)).collect()}
    assert got[(50, 20)] == 1 and max(got.values()) == 1 and min(got.values()) > 0


def test_reaches_flags_rows_with_cells(spark):
    rows = random_rows(60, 5) + [
        field.clean_row(900, "AAA", 50, -14, 0.0, 0, 0.0), field.clean_row(901, "AAA", 160, 90, 0.0, 0, 0.0)
    ]
    frames = inf.player_frames(field.clean_frame(spark, rows), ["club"])
    got = {r.player: r.reaches for r in inf.with_reach(frames).collect()}
    assert got == {p: bool(field.cells(f)) for p, f in shapes(rows).items()}


def test_complete_grid_keeps_rows_off_the_grid(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.9), (1, 110, 3, None)], "f int, x int, y int, PC double")
    out = inf.complete_grid(df, ["f"], "PC", 0.5)
    assert out.count() == 101 * 55 + 1
    assert out.filter("x = 110").first().PC == 0.5
    assert out.filter("x = 0 and y = 0").first().PC == 0.9
    loose = inf.complete_grid(df, [], "PC", 0.5)
    assert loose.count() == 101 * 55 + 1 and loose.filter("f is null").count() == 101 * 55 - 1
