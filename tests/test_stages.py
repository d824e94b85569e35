"""Snapshots of stages, and lookups that open only the parts they need."""

import pytest
from pyspark.sql import functions as F

from yardgrid.operators.clean import frame_slice
from yardgrid.sources import stages


def rows(spark, weeks=(1, 2), value=0.0):
    return spark.range(len(weeks) * 8 * 6 * 5).select(
        F.element_at(F.array(*[F.lit(w) for w in weeks]), (F.col("id") % len(weeks) + 1).cast("int")).alias("week"),
        (F.col("id") % (len(weeks) * 8)).alias("game"),
        (F.floor(F.col("id") / (len(weeks) * 8)) % 6).alias("play"),
        F.floor(F.col("id") / (len(weeks) * 48)).cast("int").alias("frame"),
        (F.col("id") + value).alias("v"),
    )


def files_read(df):
    """Rows of the result, and the files and partitions its largest scan opened."""
    found = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    leaves, opened = [plan], []
    while leaves:
        node = leaves.pop()
        if node.getClass().getName().endswith("QueryStageExec"):
            leaves.append(node.plan())
        children = node.children()
        leaves += [children.apply(i) for i in range(children.size())]
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            opened.append((metrics.apply("numFiles").value(), node.toString()))
    return found, opened


@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path)
    stages.write_stage(stages.partition_by_game(rows(spark)), root, "s", rebalance=True)
    return root


def test_slice_opens_one_part(spark, stored):
    whole = stages.read_stage(spark, stored, "s")
    assert whole.select("week", "bucket").distinct().count() == 8
    for game, play, frame in ((3, 2, None), (10, 5, 1)):
        df = stages.stored_slice(spark, stored, "s", game, play, frame)
        found, opened = files_read(df)
        assert sorted(found) == sorted(frame_slice(whole, game, play, frame, ("game", "play", "frame")).collect())
        stage_files = [n for n, text in opened if "version=" in text or "_snapshots" not in text]
        assert len(found) > 0 and min(stage_files) == 1, opened
    assert "dynamicpruning" in df._jdf.queryExecution().toString()
    assert stages.stored_slice(spark, stored, "s", 3, 99).count() == 0


def test_lookup_of_plays_prunes_by_the_index(spark, stored):
    wanted = spark.createDataFrame([(3, 2), (3, 2), (12, 0), (99, 1), (None, 2)], "game bigint, play bigint")
    df = stages.stage_lookup(spark, stored, "s", wanted)
    assert "dynamicpruning" in df._jdf.queryExecution().toString()
    found = {(r.game, r.play, r.frame, r.v) for r in df.collect()}
    whole = stages.read_stage(spark, stored, "s").filter("(game = 3 and play = 2) or (game = 12 and play = 0)")
    assert found == {(r.game, r.play, r.frame, r.v) for r in whole.collect()} and len(found) == 10
    games = stages.stage_lookup(spark, stored, "s", wanted.select("game"))
    assert games.select("game").distinct().count() == 2 and games.columns == whole.columns


def test_a_run_that_stops_leaves_the_stage_as_it_was(spark, stored, monkeypatch):
    before = sorted(stages.read_stage(spark, stored, "s").collect())

    def stop(*args):
        raise RuntimeError("stopped")

    monkeypatch.setattr(stages, "_publish", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        stages.write_stage(stages.partition_by_game(rows(spark, (2, 2), 1000.0)), stored, "s", weeks=[2])
    assert sorted(stages.read_stage(spark, stored, "s").collect()) == before
    monkeypatch.undo()
    old = stages.read_stage(spark, stored, "s")
    stages.write_stage(stages.partition_by_game(rows(spark, (2, 2), 1000.0)), stored, "s", weeks=[2])
    # A reader that began before keeps its snapshot; a new one sees the whole new week.
    assert sorted(old.collect()) == before
    now = stages.read_stage(spark, stored, "s")
    assert now.filter("week = 2 and v < 1000").count() == 0 and now.filter("week = 2").count() == 480
    assert sorted(now.filter("week = 1").collect()) == [r for r in before if r.week == 1]
    assert sorted(stages.read_stage(spark, stored, "s", snapshot=1).collect()) == before


def test_two_runs_at_once(spark, stored, monkeypatch):
    """Both start from the same snapshot: the second to publish fails and changes nothing."""
    monkeypatch.setattr(stages, "_snapshots", lambda *args: [1])
    week = stages.partition_by_game(rows(spark, (2, 2), 5.0))
    stages.write_stage(week, stored, "s", weeks=[2])
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        stages.write_stage(week, stored, "s", weeks=[2])
    monkeypatch.undo()
    assert stages.read_stage(spark, stored, "s").filter("week = 2").count() == 480


def test_drop_snapshots(spark, stored, tmp_path):
    for value in (1.0, 2.0):
        stages.write_stage(stages.partition_by_game(rows(spark, (2, 2), value)), stored, "s", weeks=[2])
    now = sorted(stages.read_stage(spark, stored, "s").collect())
    files = len(list(tmp_path.rglob("part-*")))
    stages.drop_snapshots(spark, stored, "s")
    assert sorted(stages.read_stage(spark, stored, "s").collect()) == now
    assert len(list(tmp_path.rglob("part-*"))) < files
    with pytest.raises(Exception):  # noqa: B017
        stages.read_stage(spark, stored, "s", snapshot=1).collect()


def test_weeks_that_get_no_rows_and_tables_without_parts(spark, stored):
    none = stages.partition_by_game(rows(spark)).limit(0)
    stages.write_stage(none, stored, "s", weeks=[1])
    assert {r.week for r in stages.read_stage(spark, stored, "s").select("week").distinct().collect()} == {2}
    stages.write_stage(spark.range(3), stored, "plain")
    stages.write_stage(spark.range(5), stored, "plain")
    assert stages.read_stage(spark, stored, "plain").count() == 5
    with pytest.raises(FileNotFoundError):
        stages.read_stage(spark, stored, "never written")


def cells_under_exchange(plan, marks):
    """Scans of the marked stages, and whether an exchange lies above them."""
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    todo, found = [(plan, False)], []
    while todo:
        node, under = todo.pop()
        name, text = node.getClass().getSimpleName(), node.simpleString(1000)
        if "FileSourceScan" in name and any(mark in text for mark in marks):
            found.append(under)
        children = node.children()
        todo += [(children.apply(i), under or "Exchange" in name) for i in range(children.size())]
    return found


def test_cells_stored_by_frame_are_joined_where_they_lie(spark, tmp_path):
    from yardgrid.operators import quality

    root, buckets = str(tmp_path), 5
    cells = rows(spark).select("week", "game", "play", "frame", F.lit(3).alias("x"), F.lit(4).alias("y"), "v")
    control = cells.withColumnRenamed("v", "PC")
    for week in (1, 2):  # two runs, so every stage has two versions
        stages.write_by_frame(control.filter(f"week = {week}"), root, "control", buckets)
        stages.write_by_frame(cells.withColumnRenamed("v", "value").filter(f"week = {week}"), root, "value", buckets)
    stages.write_by_frame(control.filter("week = 2").withColumn("PC", F.lit(9.0)), root, "control", buckets)
    read = stages.read_by_frame(spark, root, "control")
    assert read.count() == cells.count() and read.filter("week = 2 and PC <> 9").count() == 0
    assert stages.read_by_frame(spark, root, "control", weeks=[1]).select("week").distinct().count() == 1
    joined = quality.control_value_by_frame(
        read.drop("week"), stages.read_by_frame(spark, root, "value").drop("week"), stages.part_index(spark, root, "control")
    )
    again = quality.stored_control_value(read.drop("week"), stages.read_by_frame(spark, root, "value").drop("week"))
    assert joined.select(*again.columns).exceptAll(again).count() == 0 and joined.count() == again.count()
    sums = joined.groupBy("game", "play", "frame").agg(F.sum("value"))
    found = cells_under_exchange(sums._jdf.queryExecution().executedPlan(), ["default.by_frame_"])
    assert len(found) == 2 and not any(found)
    assert sums.count() == cells.select("game", "play", "frame").distinct().count()
    # Another session knows nothing of the tables yet.
    number = stages._snapshots(spark, root, "value")[-1]
    spark.sql(f"DROP TABLE {stages._table_name(f'{root}/value/{number}')}")
    assert stages.read_by_frame(spark.newSession(), root, "value").count() == cells.count()
    stages.write_by_frame(control.filter("week = 1"), root, "control", 7)
    with pytest.raises(ValueError, match="buckets"):
        stages.read_by_frame(spark, root, "control")
    assert stages.read_by_frame(spark, root, "control", snapshot=3).count() == cells.count()
