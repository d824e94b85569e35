import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from yardgrid.operators import models, profile
from yardgrid.operators.order import exact_quantiles, next_value, ranks_around, running_total, value_ranks


def test_running_total_over_chunks(spark):
    rng = random.Random(3)
    rows = [(g, f, rng.uniform(0, 2)) for g in (1, 2) for f in rng.sample(range(1, 60), 40)]
    rows += [(1, 200, None), (1, 201, 1.0), (2, 5, 0.25), (2, 5, 0.5)]
    df = spark.createDataFrame(rows, "g int, f int, d double")
    got = running_total(df, "d", ["g"], ["f"], "t", span=7).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [d for g, f, d in rows if g == r.g and f <= r.f]
        wanted = None if None in before else pytest.approx(sum(before))
        assert r.t == wanted


def test_running_total_over_two_order_columns(spark):
    rows = [(1, p, f, 1.0) for p in (1, 2, 3) for f in range(1, 8)]
    df = spark.createDataFrame(rows, "g int, p int, f int, d double")
    got = {(r.p, r.f): r.t for r in running_total(df, "d", ["g"], ["p", "f"], "t", span=3).collect()}
    assert got == {(p, f): (p - 1) * 7 + f for p in (1, 2, 3) for f in range(1, 8)}


def test_next_value_over_chunks(spark):
    frames = [1, 2, 5, 9, 10, 30, 31, 100]
    values = [0, None, 1, 0, 1, 0, 0, 1]
    df = spark.createDataFrame([(1, f, v) for f, v in zip(frames, values)], "g int, f int, v int")
    got = {r.f: r.n for r in next_value(df, "v", ["g"], "f", "n", span=4).collect()}
    assert got == dict(zip(frames, values[1:] + [None]))


def test_ranks_and_quantiles(spark):
    rng = random.Random(1)
    data = {c: [round(rng.gauss(c, 2), 1) for _ in range(300)] for c in (1, 2)}
    data[1] += [0.5] * 200
    df = spark.createDataFrame([(c, v) for c, vs in data.items() for v in vs], "c int, v double")
    for r in value_ranks(df, "v", ["c"], buckets=8).collect():
        assert r.n == data[r.c].count(r.v)
        assert r.below == sum(v < r.v for v in data[r.c])
        assert r.total == len(data[r.c])
    shares = {"a": 0.1, "b": 0.5, "c9": 0.9, "top": 1.0}
    for r in exact_quantiles(df, "v", shares, ["c"]).collect():
        for name, share in shares.items():
            assert r[name] == pytest.approx(np.quantile(data[r.c], share))


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(500).select(
        "id", F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("y"), (F.col("id") * 0.01).alias("v")
    )
    split = models.stratified_split(df, "y", 0.75, ["id"], seed=5)
    sizes = {r.y: (r.n, r.t) for r in split.groupBy("y").agg(
        F.count("*").alias("n"), F.sum(F.col("is_train").cast("int")).alias("t")).collect()}
    assert sizes == {1: (72, 54), 0: (428, 321)}
    again = models.stratified_split(df.repartition(7), "y", 0.75, ["id"], seed=5)
    chosen = {r.id for r in split.filter("is_train").collect()}
    assert chosen == {r.id for r in again.filter("is_train").collect()}
    layered = models.stratified_split(df, "v", 0.8, ["id"], groups=5)
    assert layered.count() == 500
    assert layered.filter("is_train").count() == 4 * 100


def test_histogram_and_boxes(spark):
    values = [0.1, 0.2, 0.4, 0.9, 1.1, 1.2, 9.0]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, c int")
    bins = {r.bin: r.n for r in profile.histogram(df, "v", 0.5).collect()}
    wanted = {}
    for v in values:
        b = math.ceil((v - 0.25) / 0.5)
        wanted[b] = wanted.get(b, 0) + 1
    assert bins == wanted
    density = profile.histogram(df, "v").collect()
    width = (9.0 - 0.1) / 29
    assert sum(r.density for r in density) * width == pytest.approx(1)
    box = profile.box_stats(df, "v", ["c"]).first()
    assert box.median == 0.9 and box.outliers == 1 and box.high == 1.2 and box.low == 0.1


def test_qq_levels_and_classes(spark):
    df = spark.createDataFrame([(0.2, 1), (0.2, 0), (0.7, 1), (1.0, 1)], "p double, y int")
    qq = {r.p: (r["first"], r["last"]) for r in profile.qq_uniform(df, "p").collect()}
    assert qq[0.2] == pytest.approx((0.625 / 4.25, 1.625 / 4.25))
    assert qq[1.0] == pytest.approx((3.625 / 4.25, 3.625 / 4.25))
    levels = {r.level: r.n for r in profile.level_bins(df, "p", [0.2, 0.6, 1.0]).collect()}
    assert levels == {1: 2, 2: 1}
    m = profile.confusion_matrix(df, "p", "y").first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 0, 1, 1) and m.accuracy == 0.75
    loss = profile.log_loss(df.filter("p < 1"), "p", "y").first()[0]
    assert loss == pytest.approx(-(math.log(0.2) + math.log(0.8) + math.log(0.7)) / 3)
    sure = profile.log_loss(df.filter("p = 1"), "p", "y").first()[0]
    assert 0 <= sure < 1e-12


def test_binomial_fits(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for _ in range(600):
        x = rng.uniform(0, 20)
        rows.append((x, int(rng.random() < 1 / (1 + math.exp(1.2 - 0.25 * x)))))
    df = spark.createDataFrame(rows, "sum_quality double, tackling int")
    x = np.column_stack([np.ones(600), [r[0] for r in rows]])
    y = np.array([r[1] for r in rows], dtype=float)
    cdf = np.vectorize(lambda e: 0.5 * (1 + math.erf(e / math.sqrt(2))))
    links = {
        "logit": (lambda e: 1 / (1 + np.exp(-e)), lambda e: np.exp(-e) / (1 + np.exp(-e)) ** 2),
        "probit": (cdf, lambda e: np.exp(-e * e / 2) / math.sqrt(2 * math.pi)),
        "cloglog": (lambda e: 1 - np.exp(-np.exp(e)), lambda e: np.exp(e - np.exp(e))),
    }
    for link, (mean, slope) in links.items():
        b = np.zeros(2)
        for _ in range(30):
            eta = x @ b
            mu, g = mean(eta), slope(eta)
            w = g * g / (mu * (1 - mu))
            b = b + np.linalg.solve(x.T * w @ x, x.T @ ((y - mu) * g / (mu * (1 - mu))))
        model = models.fit_tackle_model(df, link)
        assert [model.intercept, model.coefficients[0]] == pytest.approx(list(b), abs=1e-4)
    path = str(tmp_path / "model")
    models.save_model(model, path)
    scored = models.score(models.load_model(path), df)
    row = scored.first()
    assert row.prediction == pytest.approx(1 - math.exp(-math.exp(b[0] + b[1] * row.sum_quality)), abs=1e-4)
    as_logistic = models.score(model, df, logistic_link=True).first()
    assert as_logistic.prediction == pytest.approx(1 / (1 + math.exp(-(b[0] + b[1] * row.sum_quality))), abs=1e-4)
    with pytest.raises(ValueError):
        models.fit_tackle_model(df, "other")


def test_missing_classes_are_classes(spark):
    rows = [("a", float(i)) for i in range(20)] + [(None, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "kind string, v double")
    boxes = {r.kind: r for r in profile.box_stats(df, "v", ["kind"]).collect()}
    assert set(boxes) == {"a", None} and boxes[None].median == 2.0 and boxes[None].n == 5
    bins = profile.histogram(df, "v", by=["kind"], bins=5).collect()
    assert sum(r.n for r in bins if r.kind is None) == 5
    # Each class has its own range.
    assert max(r.centre for r in bins if r.kind is None) == pytest.approx(4.0)
    points = {(r.kind, r.v): r.first for r in profile.qq_uniform(df, "v", ["kind"]).collect()}
    assert points["a", 0.0] == pytest.approx(0.5 / 20)
    assert points[None, 0.0] == pytest.approx((1 - 0.375) / 5.25)


def test_rows_without_a_target_stay_in_the_split(spark):
    rows = [(i, i % 2 if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, y int")
    split = models.stratified_split(df, "y", 0.75, ["k"]).collect()
    assert len(split) == 40
    for label in (0, 1, None):
        part = [r.is_train for r in split if r.y == label]
        assert sum(part) == -(-3 * len(part) // 4)


def test_ranks_around_are_exact_and_leave_the_other_rows(spark):
    rng = random.Random(4)
    data = {c: [rng.gauss(c, 2) for _ in range(400)] + [0.5] * 300 for c in (1, 2)}
    df = spark.createDataFrame([(c, v) for c, vs in data.items() for v in vs] + [(None, 1.0), (1, None)], "c int, v double")
    found = ranks_around(df, "v", [F.floor(F.col("total") * 0.3)], ["c"]).collect()
    for c, values in data.items():
        ordered = sorted(values)
        near = [r for r in found if r.c == c]
        assert all(r.n == values.count(r.v) and r.below == sum(v < r.v for v in values) and r.total == 700 for r in near)
        assert any(r.v == ordered[210] for r in near) and len(near) < 100
    assert [(r.v, r.n, r.below, r.total) for r in found if r.c is None] == [(1.0, 1, 0, 1)]


def test_split_keeps_the_rows_where_they_are(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(2000).selectExpr("id", "id * 0.001 as v").write.parquet(path)
    df = spark.read.parquet(path)
    plain = models.stratified_split(df, "v", 0.75, ["id"], seed=5, groups=4)
    stored = models.stratified_split(df.withColumn("h", models.key_hash(["id"], 5)), "v", 0.75, ["id"], 5, 4, hashed_as="h")
    assert {r.id for r in plain.filter("is_train").collect()} == {r.id for r in stored.filter("is_train").collect()}
    # Joins of the rows with the cuts and the chosen buckets have a built side that is broadcast.
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_a_stored_training_set_is_little_more_than_its_control(spark):
    rng = np.random.default_rng(3)
    n = 60_000
    df = spark.range(n).selectExpr(
        "id div 5000 as game", "1L as play", "cast(id div 500 % 10 as int) as frame", "cast(id div 25 % 20 as int) as x",
        "cast(id % 25 as int) as y", "cast(id div 500 as double) as x_car", "1.0D as y_car", "id",
    )
    values = spark.createDataFrame(list(enumerate(rng.random(n).tolist())), "id bigint, PC double")
    df = df.join(values, "id").drop("id")
    stored = models.settled_for_split(df)
    size = sum(os.path.getsize(f.removeprefix("file:")) for f in stored.inputFiles())
    assert size < 11 * n  # eight bytes are the control; whole hashes take eight more
    for groups in (None, 5):
        there, plain = models.pc_split(stored, groups=groups), models.pc_split(df, groups=groups)
        assert set(there.columns) == {*df.columns, "is_train"}
        assert there.exceptAll(plain.select(there.columns)).count() == 0 and there.count() == n
    # All rows of a stratum have one byte: the cut is found by the rest of the hash.
    same = df.withColumn("_key_prefix", F.lit("cc")).filter(models.key_prefix(models.SPLIT_KEYS, 12) == "cc")
    split = models.pc_split(same, groups=None)
    kept = same.count()
    assert 0 < kept < n / 100 and split.filter("is_train").count() == math.ceil(0.8 * kept)


def test_ranks_are_found_in_parts_of_a_bucket(spark):
    rng = random.Random(5)
    values = [rng.randrange(4000) for _ in range(3000)]
    df = spark.createDataFrame([(v, v % 3) for v in values] + [(7, None)], "k int, c int")
    found = ranks_around(
        df, "v", [F.floor(F.col("total") * 0.4)], ["c"], bucket=F.floor(F.col("k") / 2000),
        finer=F.floor(F.col("v") / 20), made=F.col("k") * 2,
    ).collect()
    for c in range(3):
        group = sorted(2 * v for v in values if v % 3 == c)
        near = [r for r in found if r.c == c]
        assert all(r.n == group.count(r.v) and r.below == sum(v < r.v for v in group) and r.total == len(group) for r in near)
        assert any(r.v == group[int(len(group) * 0.4)] for r in near) and len(near) <= 10
    assert [(r.v, r.n, r.below, r.total) for r in found if r.c is None] == [(14, 1, 0, 1)]
