from pathlib import Path

import pytest
from pyspark.sql import functions as F

from yardgrid.plans.adapter import Season
from yardgrid.plans.season import Inputs, run_weeks
from yardgrid.session import settle
from yardgrid.sources import signal, stages, tables

SMALL = "/root/testdata/sf0.001"


def test_csv_readers(spark, tmp_path):
    header = "gameId,playId,nflId,displayName,frameId,time,jerseyNumber,club,playDirection,x,y,s,a,dis,o,dir,event\n"
    for week in (1, 2, 11):
        (tmp_path / f"tracking_week_{week}.csv").write_text(
            header + f"20220{week},56,35472,Q. Nelson,1,t,56,LA,left,88.37,27.27,1.62,1.1,0.16,231.7,147.9,NA\n"
            + f"20220{week},56,NA,football,1,t,NA,football,left,88.0,27.0,1.0,1.1,0.1,NA,NA,pass_arrived\n"
        )
    df = tables.read_tracking(spark, str(tmp_path))
    assert {r.week for r in df.collect()} == {1, 2, 11} and df.count() == 6
    ball = df.filter("nflId is null and week = 11").first()
    assert ball.event == "pass_arrived" and ball.dir is None and ball.gameId == 2022011
    assert tables.read_tracking(spark, str(tmp_path), [2]).select("week").distinct().first().week == 2
    (tmp_path / "games.csv").write_text("season,gameId,week,homeTeamAbbr,visitorTeamAbbr\n2022,7,3,BUF,LA\n")
    game = tables.read_games(spark, str(tmp_path / "games.csv")).first()
    assert (game.gameId, game.week, game.visitorTeamAbbr) == (7, 3, "LA")
    (tmp_path / "c.tsv").write_text("teams\tcolor1\tcolor2\tcolor1_family\nLA\t#003594\t#ffd100\tblue\n")
    assert tables.read_team_colors(spark, str(tmp_path / "c.tsv")).first().color2 == "#ffd100"
    for name, read, text in (
        ("plays", tables.read_plays, "gameId,playId,ballCarrierId,quarter\n1,2,3,4\n"),
        ("tackles", tables.read_tackles, "gameId,playId,nflId,tackle,assist,forcedFumble,pff_missedTackle\n1,2,3,1,0,0,0\n"),
        ("players", tables.read_players, "nflId,height,weight,position,displayName\n3,6-4,200,QB,A B\n"),
        ("pbp", tables.read_pbp, "play_id,old_game_id,pass,rush,sack,qb_scramble,play_type,fumble,defteam\n2,1,1,0,0,0,pass,0,LA\n"),
        ("rosters", tables.read_rosters, "gsis_it_id,position,team,headshot_url\n3,QB,LA,u\n"),
    ):
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        assert read(spark, str(path)).count() == 1
    stored = str(tmp_path / "pbp.parquet")
    tables.read_pbp(spark, str(tmp_path / "pbp.csv")).write.parquet(stored)
    assert tables.read_pbp(spark, stored).first().old_game_id == "1"


@pytest.mark.parametrize("m", [4, 5, 13, 16])
def test_game_buckets_follow_the_cut_points(spark, m):
    games = spark.createDataFrame([(1, 100 + i) for i in range(m)], "week int, game bigint")
    cuts = [i * m // 4 for i in range(4)]
    got = {r.game: r.bucket for r in stages.game_buckets(games).collect()}
    assert got == {100 + i: sum(i >= cut for cut in cuts) - 1 for i in range(m)}


def test_stage_overwrites_only_its_weeks(spark, tmp_path):
    root = str(tmp_path)
    both = spark.createDataFrame([(1, 10, 1.0), (2, 20, 2.0)], "week int, game bigint, v double")
    stages.write_stage(stages.partition_by_game(both), root, "s", rebalance=True)
    again = spark.createDataFrame([(2, 20, 5.0)], "week int, game bigint, v double")
    stages.write_stage(stages.partition_by_game(again), root, "s")
    df = stages.read_stage(spark, root, "s")
    assert {(r.week, r.v) for r in df.collect()} == {(1, 1.0), (2, 5.0)}
    pruned = stages.read_stage(spark, root, "s", weeks=[2])
    assert "PartitionFilters: [isnotnull(week" in pruned._jdf.queryExecution().toString()
    assert stages.read_stage(spark, root, "s", games=again).count() == 1


def test_signal(spark, tmp_path):
    rows = [(1.0, 2.0, n, r, None, 9) for n in ("AT&T", "Telcel") for r in (-121.0, -44.0, -122.0, -43.0, None)]
    df = spark.createDataFrame(
        rows, "client_latitude double, client_longitude double, network_operator_name string, rsrp double, result_date timestamp, other int"
    )
    df.write.parquet(str(tmp_path / "in"))
    read = signal.read_signal(spark, str(tmp_path / "in"))
    assert "other" not in read.columns
    assert signal.selected_signal(read).count() == 4
    assert signal.selected_signal(read, "todos").count() == 4
    signal.export_signal(read, "AT&T", str(tmp_path / "out"))
    assert {r.rsrp for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {-121.0, -44.0}
    assert len(list(Path(tmp_path / "out").glob("part-*"))) == 1


def test_settled_table_has_no_lineage(spark):
    df = settle(spark.range(10).withColumn("v", F.col("id") * 2))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()


def test_weekly_run(spark, tmp_path):
    season = Season(spark, SMALL)
    inputs = Inputs(season.tracking, season.plays, season.pbp, season.tackles)
    root = str(tmp_path)
    run_weeks(spark, inputs, root, weeks=[1])
    stage = lambda name: stages.read_stage(spark, root, name)
    frames = stage("clean").select("gameId", "playId", "frameId").distinct().count()
    control = stage("pitch_control")
    assert control.select("game", "play", "frame").distinct().count() == frames
    assert control.filter("x <= 100").count() == frames * 5555
    assert control.filter("PC <= 0 or PC >= 1").count() == 0
    assert stage("influence").filter("influ <= 0 or influ > 1").count() == 0
    assert stage("quality").count() <= stage("all_quality").count()
    assert {"week", "bucket"} <= set(stage("value_map").columns)


def test_files_with_columns_in_another_order(spark, tmp_path):
    (tmp_path / "tracking_week_1.csv").write_text("gameId,playId,nflId,frameId,x,y\n1,2,3,4,10.5,20.5\n")
    (tmp_path / "tracking_week_2.csv").write_text("y,x,frameId,nflId,playId,gameId\n20.5,10.5,4,3,2,1\n")
    rows = tables.read_tracking(spark, str(tmp_path)).select("week", "gameId", "x", "y").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, 10.5, 20.5), (2, 1, 10.5, 20.5)]


def test_text_that_is_no_number_fails(spark, tmp_path):
    (tmp_path / "games.csv").write_text("gameId,week,homeTeamAbbr,visitorTeamAbbr\n7,three,BUF,LA\n")
    with pytest.raises(Exception, match="column week"):
        tables.read_games(spark, str(tmp_path / "games.csv")).collect()


def test_second_run_of_a_week_replaces_all_of_it(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0)], "week int, bucket int, v double")
    stages.write_stage(rows, root, "s", weeks=[1, 2])
    stages.write_stage(rows.filter("week = 1 and bucket = 0"), root, "s", weeks=[1])
    assert {r.v for r in stages.read_stage(spark, root, "s").collect()} == {1.0, 3.0}


def test_weeks_are_written_and_read_without_a_plan_for_each(spark, tmp_path):
    rows = spark.range(60).selectExpr("id as gameId", "id % 4 as playId", "id * 0.5 as x", "cast(id % 20 + 1 as int) as week")
    for odd, names in ((0, ["gameId", "playId", "x"]), (1, ["x", "playId", "gameId"])):
        tables.write_tracking(rows.filter(F.col("week") % 2 == odd).select(*names, "week"), str(tmp_path))
    read = tables.read_tracking(spark, str(tmp_path))
    assert read._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    found = {(r.week, r.gameId, r.playId, r.x) for r in read.collect()}
    assert found == {(r.week, r.gameId, r.playId, r.x) for r in rows.collect()}
    assert {r.week for r in tables.read_tracking(spark, str(tmp_path), [3, 4]).collect()} == {3, 4}
