import math
import re

import pytest
from pyspark.sql import functions as F

from tests import field
from tests.test_influence import shapes
from yardgrid.operators import control as k
from yardgrid.operators import influence as inf
from yardgrid.operators import quality as q

PLAYS = "gameId bigint, playId bigint, ballCarrierId bigint, possessionTeam string, defensiveTeam string"


def one_frame():
    return [
        field.clean_row(1, "AAA", 40, 25, 4, 80, 0.0),
        field.clean_row(2, "AAA", 44, 30, 6, 200, 6.4),
        field.clean_row(3, "BBB", 38, 22, 5, 10, 3.6),
        field.clean_row(4, "BBB", 108, 40, 2, 300, 60.0),
        field.clean_row(5, "CCC", 70, 50, 1, 45, 30.0),
    ]


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame([(1, 1, 1, "AAA", "BBB")], PLAYS)


def by_hand(rows):
    """PC and value of one frame."""
    sign = {"AAA": -1, "BBB": 1, "CCC": 0}
    clubs = {r[3]: r[4] for r in rows}
    net, value = {}, {}
    for player, f in shapes(rows).items():
        for cell, influ in field.cells(f).items():
            if player == 1:
                value[cell] = influ
            else:
                net[cell] = net.get(cell, 0) + sign[clubs[player]] * influ
    pc = {(x, y): 0.5 for x in range(101) for y in range(55)}
    pc.update({cell: field.logistic(v) for cell, v in net.items()})
    return pc, value


def surface(df, value="PC"):
    return {(r.x, r.y): r[value] for r in df.collect()}


def close(got, wanted):
    assert got.keys() == wanted.keys()
    for cell, v in wanted.items():
        assert got[cell] == (None if v is None else pytest.approx(v, abs=1e-9))


@pytest.mark.parametrize("crowd", [2000, 2])
def test_pitch_control_by_hand(spark, plays, crowd):
    rows = one_frame()
    frames = k.framed_sides(field.clean_frame(spark, rows), plays)
    pc, value = by_hand(rows)
    close(surface(k.control_surface(k.without_carrier(frames), crowd=crowd)), pc)
    close(surface(k.value_surface(frames), "value"), value)
    assert len(pc) > 5555 and all(0 < v < 1 for v in pc.values())


def test_stored_route_agrees(spark, plays):
    clean = field.clean_frame(spark, one_frame())
    clubs = k.player_clubs(clean)
    close(surface(k.pitch_control(inf.influence(clean), clubs, plays)), by_hand(one_frame())[0])
    close(surface(k.value_map(inf.influence(clean), plays), "value"), by_hand(one_frame())[1])


@pytest.mark.parametrize("crowd", [2000, 2])
def test_control_value_equals_joined_surfaces(spark, plays, crowd):
    rows = one_frame() + [field.clean_row(1, "AAA", 101, 25, 5, 270, 0.0, frame=2)]
    rows += [field.clean_row(3, "BBB", 20, 20, 2, 0, 80.0, frame=2)]
    rows += [field.clean_row(1, "AAA", 50, 25, 5, 270, 0.0, frame=3)]
    frames = k.framed_sides(field.clean_frame(spark, rows), plays)
    fused = k.control_value(frames, crowd)
    joined = q.stored_control_value(
        k.control_surface(k.without_carrier(frames)), k.value_surface(frames)
    )

    def rowset(df):
        return {
            (r.frame, r.x, r.y): (None if r.PC is None else round(r.PC, 9), round(r.value, 9))
            for r in df.collect()
        }

    got = rowset(fused)
    assert got == rowset(joined)
    # Off the grid where nobody else reaches, and in the frame of the carrier alone.
    assert any(f == 2 and x > 100 and v[0] is None for (f, x, _), v in got.items())
    assert all(v[0] is None for (f, _, _), v in got.items() if f == 3)


def test_stray_cells_are_counted(spark, plays):
    rows = one_frame() + [field.clean_row(6, "BBB", 50, -1, 14.0, 0, 0.0)]
    frames = k.framed_sides(field.clean_frame(spark, rows), plays)
    got = surface(k.control_surface(k.without_carrier(frames)))
    assert any(y < 0 for _, y in got)
    close(got, by_hand(rows)[0])


def test_copies_add_up(spark, plays):
    rows = one_frame()
    twice = k.framed_sides(field.clean_frame(spark, rows + [rows[2]] * 5), plays)
    got = surface(k.control_surface(k.without_carrier(twice), crowd=4))
    f = field.cells(shapes(rows)[3])
    far = max(f, key=lambda c: f[c])
    others = sum(
        s * field.cells(shapes(rows)[p]).get(far, 0) for p, s in ((2, -1), (4, 1), (5, 0))
    )
    assert got[far] == pytest.approx(field.logistic(6 * f[far] + others))


@pytest.mark.parametrize("crowd", [2000, 2])
def test_capped_and_individual(spark, plays, crowd):
    rows = one_frame() + [field.clean_row(7, "BBB", 41, 27, 3, 120, 2.2)]
    clean = field.clean_frame(spark, rows)
    frames = k.framed_sides(clean, plays)
    near = inf.player_frames(clean.filter("distance_to_ball <= 6.5"), ["club"]).select(
        "game", "play", "frame", "player", F.col("club").alias("team")
    )
    strong = {
        p: {c: v for c, v in field.cells(f).items() if v >= 0.01}
        for p, f in shapes(rows).items()
        if p in (2, 3, 7)
    }

    def capped(players):
        total = {}
        for p in players:
            for c, v in strong[p].items():
                total[c] = total.get(c, 0) + v
        return {c: min(v, 1) for c, v in total.items()}

    close(surface(k.capped_control(frames, near, crowd=crowd)), capped([2, 3, 7]))
    defenders = near.filter("team = 'BBB'")
    individual = k.individual_control(frames, near, defenders, crowd=crowd)
    for defender in (3, 7):
        close(surface(individual.filter(f"defender = {defender}")), capped([defender, 2]))


def test_home_away(spark, plays):
    games = spark.createDataFrame(
        [(1, 1, "BBB", "AAA")], "gameId bigint, week int, homeTeamAbbr string, visitorTeamAbbr string"
    )
    clean = field.clean_frame(spark, one_frame())
    frames = k.framed_home_away(clean, plays, games)
    got = surface(k.control_surface(k.without_carrier(frames), "home", "away"))
    close(got, by_hand(one_frame())[0])
    sides = k.week_sides(k.player_clubs(clean), games)
    assert {(r.nflId, r.club) for r in sides.collect()} == {
        (1, "away"), (2, "away"), (3, "home"), (4, "home")
    }
    loose = k.home_away_control(inf.influence(clean), sides)
    assert loose.filter("game is null").count() > 0 and "frame" not in loose.columns


def test_quality_summary_by_hand(spark, plays):
    rows = one_frame()
    clean = field.clean_frame(spark, rows)
    cells = k.control_value(k.framed_sides(clean, plays))
    flagged = clean.withColumn("min_dist", F.lit(1))
    out = {r.tackler: r for r in q.quality_summary(cells, q.tackler_ellipses(flagged, 7)).collect()}
    pc, value = by_hand(rows)
    assert set(out) == {1, 2, 3}
    for player in (2, 3):
        inside = field.cells(dict(shapes(rows)[player]))
        products = sorted(pc[c] * v for c, v in value.items() if c in inside)
        n = len(products)
        median = (products[(n - 1) // 2] + products[n // 2]) / 2
        row = out[player]
        assert row.sum_quality == pytest.approx(sum(products))
        assert row.mean_quality == pytest.approx(sum(products) / n)
        assert row.median_quality == pytest.approx(median)
        assert row.max_quality == pytest.approx(products[-1])
        assert math.isclose(row.distance, {2: 6.4, 3: 3.6}[player])


def test_copies_of_a_tackler_count(spark, plays):
    clean = field.clean_frame(spark, one_frame())
    cells = k.control_value(k.framed_sides(clean, plays))
    ellipses = q.tackler_ellipses(clean.withColumn("min_dist", F.lit(1)), 7)
    thrice = ellipses.union(ellipses).union(ellipses)
    once = {r.tackler: r for r in q.quality_summary(cells, ellipses).collect()}
    for r in q.quality_summary(cells, thrice).collect():
        assert r.sum_quality == pytest.approx(3 * once[r.tackler].sum_quality)
        for name in ("mean_quality", "median_quality", "max_quality"):
            assert r[name] == pytest.approx(once[r.tackler][name])


def test_missing_control_makes_the_summary_missing(spark, plays):
    rows = [field.clean_row(1, "AAA", 101, 25, 5, 270, 0.0), field.clean_row(3, "BBB", 20, 20, 2, 0, 80.0)]
    clean = field.clean_frame(spark, rows)
    cells = k.control_value(k.framed_sides(clean, plays))
    flagged = clean.withColumn("min_dist", F.lit(1))
    row = q.quality_summary(cells, q.tackler_ellipses(flagged)).first()
    assert row.tackler == 1 and row.sum_quality is None and row.median_quality is None


def test_surfaces_do_not_shuffle_cells(spark, plays):
    frames = k.framed_sides(field.clean_frame(spark, one_frame()), plays)
    surface_ = k.control_surface(k.without_carrier(frames), grid=False)
    plan = surface_._jdf.queryExecution().executedPlan().toString()
    # Ordinary frames come together where the crowded ones are taken out, before they are spread.
    assert "Exchange" not in plan.split("LeftAnti")[0]


def _exchanged_keys(df):
    """The keys of the exchanges of a plan, without numbers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)}


def test_cells_of_an_influence_table_by_play_are_not_exchanged(spark, plays):
    clean = field.clean_frame(spark, one_frame())
    stored = inf.influence_by_play(clean)
    control = k.pitch_control(stored, k.player_clubs(clean), plays)
    value = k.value_map(stored, plays)
    for df in (control, value):
        summed = df.groupBy("game", "play", "frame").count()
        assert not any("frame" in keys or ", x" in keys for keys in _exchanged_keys(summed))
    close(surface(control), by_hand(one_frame())[0])
    close(surface(value, "value"), by_hand(one_frame())[1])


def test_stored_control_meets_value_by_frame(spark, plays, tmp_path):
    frames = k.framed_sides(field.clean_frame(spark, one_frame()), plays)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, df in (("control", k.control_surface(k.without_carrier(frames))), ("value", k.value_surface(frames))):
        df.write.parquet(str(tmp_path / name))
    placed = [spark.read.parquet(str(tmp_path / n)).repartition(parts, "game", "play", "frame") for n in ("control", "value")]
    joined = q.stored_control_value(*placed)
    assert not any(", x" in keys for keys in _exchanged_keys(joined))
    twice = q.stored_control_value(placed[0], placed[1].unionByName(placed[1]))
    assert twice.count() == 2 * joined.count() == 2 * placed[1].count()


def _unfolded(columns, values, name):
    cells = columns.select("x", "y", F.posexplode(values).alias("i", name)).filter(f"{name} is not null")
    return cells.select("x", (F.col("y") + F.col("i")).alias("y"), name)


@pytest.mark.parametrize("crowd", [2000, 2])
def test_field_columns_hold_every_cell_of_the_surfaces(spark, plays, crowd):
    """Also the cells beside the lanes, of a centre far off the field, as the carrier's and as another's."""
    for far in (2, 1):
        rows = [*one_frame()[:3], field.clean_row(far, "AAA", 50, -1, 14.0, 0, 0.0, frame=2), field.clean_row(3, "BBB", 20, 10, 3, 0, 9.0, frame=2)]
        frames = k.framed_sides(field.clean_frame(spark, rows), plays)
        others = k.without_carrier(frames)
        control, value = k.control_columns(others, crowd=crowd), k.value_columns(frames)
        for frame in (1, 2):
            where = f"frame = {frame}"
            cells = surface(k.control_surface(others, crowd=crowd).filter(where))
            close(surface(_unfolded(control.filter(where), "PCs", "PC")), cells)
            close(surface(_unfolded(value.filter(where), "values", "value"), "value"), surface(k.value_surface(frames).filter(where), "value"))
        assert control.filter("y = 0").count() < 260  # not a row for each of more than 11,110 cells
        strays = control.filter("y <> 0").count() + value.filter("y > 54 or y < 0").count()
        assert strays > 0


def test_field_columns_stored_by_frame_meet_where_they_lie(spark, plays, tmp_path):
    from tests.test_stages import cells_under_exchange
    from yardgrid.sources import stages

    rows = [*one_frame(), field.clean_row(1, "AAA", 105, 20, 5, 0, 0.0, frame=2), field.clean_row(3, "BBB", 20, 10, 3, 0, 9.0, frame=2)]
    frames = k.framed_sides(field.clean_frame(spark, rows), plays)
    others = k.without_carrier(frames)
    stages.write_by_frame(k.control_columns(others), str(tmp_path), "control", 3)
    stages.write_by_frame(k.value_columns(frames), str(tmp_path), "value", 3)
    index = stages.part_index(spark, str(tmp_path), "control")
    control, value = (stages.read_by_frame(spark, str(tmp_path), name) for name in ("control", "value"))
    cells = q.control_value_by_column(control, value, index)
    wanted = q.stored_control_value(k.control_surface(others), k.value_surface(frames))
    found, wanted = ({(r.frame, r.x, r.y): (r.PC, r.value) for r in df.collect()} for df in (cells, wanted))
    close({c: v[0] for c, v in found.items()}, {c: v[0] for c, v in wanted.items()})
    close({c: v[1] for c, v in found.items()}, {c: v[1] for c, v in wanted.items()})
    assert cells.count() == len(found) and {v[0] is None for v in found.values()} == {True, False}
    sums = cells.groupBy("game", "play", "frame").agg(F.sum("value"))
    under = cells_under_exchange(sums._jdf.queryExecution().executedPlan(), ["default.by_frame_"])
    assert len(under) == 2 and not any(under)
    twice = q.control_value_by_column(control, value.unionByName(value), index)
    assert twice.count() == 2 * len(found)
    assert q.control_value_by_column(control, value, index.filter("false")).count() == 0
