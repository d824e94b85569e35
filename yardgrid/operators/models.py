"""Splits, binomial models of tackle success, and the regression of control on positions."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    GeneralizedLinearRegression,
    GeneralizedLinearRegressionModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardgrid.functions.nulls import join_alike
from yardgrid.functions.scoring import logistic
from yardgrid.operators.clean import PLAY, PLAYER_PLAY
from yardgrid.operators.influence import CELL_FRAME
from yardgrid.operators.order import exact_quantiles, ranks_around
from yardgrid.session import fan_out, settle

LINKS = ("logit", "probit", "cloglog")


def _strata(df: DataFrame, target: str, groups: int, bucket: Column | None = None) -> DataFrame:
    """Adds the number of the quantile interval of a continuous target; ``groups`` bounds, both
    ends in. The inner bounds are exact quantiles, interpolated between neighbouring values; their
    ranks are found bucket by bucket. They are one row of at most ``groups`` numbers."""
    shares = {f"q{i}": i / (groups - 1) for i in range(1, groups - 1)}
    if not shares:
        return df.withColumn("_stratum", F.lit(0))
    bounds = exact_quantiles(df, target, shares, bucket=bucket).select(F.array(*shares).alias("bounds")).scalar()
    # Comparisons one by one are compiled, a function over the array is not.
    passed = [F.when(F.get("_bounds", F.lit(i)) < F.col(target), 1).otherwise(0) for i in range(len(shares))]
    return df.withColumn("_bounds", bounds).withColumn("_stratum", reduce(add, passed)).drop("_bounds")


def stratified_split(
    df: DataFrame,
    target: str,
    share: float,
    keys: Sequence[str],
    seed: int = 12,
    groups: int | None = None,
    hashed_as: str | None = None,
    prefixed_as: str | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Adds ``is_train``: within each stratum the ``ceil(share * n)`` rows of smallest key hash.

    A stratum is a label (a missing one too), or with ``groups`` a quantile interval of a
    continuous target. Rows are counted by stratum and leading 16 bits of the hash where they lie;
    of each stratum only the bucket that holds the cut is ranked. So rows do not travel, and the
    result does not depend on partitions. Rows only meet the table of cuts, one for each stratum.

    ``hashed_as`` names a column that holds :func:`key_hash` of the same keys and seed already; it
    goes with the result. With ``groups``, ``prefixed_as`` names one that holds their :func:`key_prefix`,
    which tells for all but one row in 256 on which side of the cut they are; only these are hashed.
    ``bucket`` of the continuous target is that of :func:`exact_quantiles`.
    """
    layered = df.withColumn("_stratum", F.col(target)) if groups is None else _strata(df, target, groups, bucket)
    wanted = F.ceil(F.col("total") * F.lit(share))
    if prefixed_as:
        ranks = ranks_around(
            layered, "_hash", [wanted - 1], ["_stratum"], bucket=F.col(prefixed_as),
            finer=F.shiftright("_hash", 36), made=key_hash(keys, seed),
        )
    else:
        layered = layered.withColumn("_hash", F.col(hashed_as) if hashed_as else key_hash(keys, seed))
        ranks = ranks_around(layered, "_hash", [wanted - 1], ["_stratum"], bucket=F.shiftright("_hash", 44))
    cuts = ranks.filter(F.col("below") < wanted).groupBy("_stratum").agg(F.max("_hash").alias("_cut"))
    if prefixed_as:
        # As few as the strata, and numbered as they are: a list instead of a table to join.
        listed = [F.max(F.when(F.col("_stratum") == i, F.col("_cut"))) for i in range(max(groups - 1, 1))]
        cut = F.get(cuts.agg(F.array(*listed)).scalar(), F.col("_stratum"))
        first = F.lpad(F.lower(F.hex(F.shiftright("_cut", 52))), 2, "0")
        firsts = [F.max(F.when(F.col("_stratum") == i, first)) for i in range(max(groups - 1, 1))]
        beside, at = F.col(prefixed_as), F.get(cuts.agg(F.array(*firsts)).scalar(), F.col("_stratum"))
        is_train = F.when(beside != at, beside < at).otherwise(key_hash(keys, seed) <= cut)
        return layered.withColumn("is_train", is_train).drop("_stratum")
    placed = join_alike(layered, F.broadcast(cuts), ["_stratum"])
    return placed.withColumn("is_train", F.col("_hash") <= F.col("_cut")).drop("_stratum", "_hash", "_cut")


def _key_digest(keys: Sequence[str], seed: int) -> Column:
    """The MD5 of keys and seed, joined by bars; a missing key is an empty text."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def key_hash(keys: Sequence[str], seed: int) -> Column:
    """60 bits of the MD5 of keys and seed, joined by bars; a missing key is an empty text."""
    return F.conv(F.substring(_key_digest(keys, seed), 1, 15), 16, 10).cast("bigint")


def key_prefix(keys: Sequence[str], seed: int) -> Column:
    """The first 8 bits of :func:`key_hash` as two digits, in the same order."""
    return F.substring(_key_digest(keys, seed), 1, 2)


# -- binomial models -----------------------------------------------------------------------


def _featured(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df)


def fit_tackle_model(
    df: DataFrame, link: str = "logit", feature: str = "sum_quality", label: str = "tackling"
) -> GeneralizedLinearRegressionModel:
    """Binomial model of the label on one feature.

    The fit reads its input once per iteration, so the input is settled first.
    """
    if link not in LINKS:
        raise ValueError(f"unknown link {link!r}")
    known = df.filter(F.col(feature).isNotNull() & F.col(label).isNotNull())
    data = settle(_featured(known.select(feature, F.col(label).cast("double")), [feature]))
    estimator = GeneralizedLinearRegression(
        family="binomial",
        link=link,
        labelCol=label,
        featuresCol="features",
        maxIter=50,
        tol=1e-9,
        linkPredictionCol="link_value",
    )
    return estimator.fit(data)


def coefficients(df: DataFrame, link: str, **columns: str) -> DataFrame:
    """Intercept and slope of the fit as one row next to its link."""
    return curve_of(df.sparkSession, fit_tackle_model(df, link, **columns), link)


def curve_of(spark: SparkSession, model: GeneralizedLinearRegressionModel, link: str) -> DataFrame:
    """Intercept and slope of a fitted or loaded model as one row."""
    row = (link, float(model.intercept), float(model.coefficients[0]))
    return spark.createDataFrame([row], "link string, intercept double, slope double")


def score(
    model: GeneralizedLinearRegressionModel,
    df: DataFrame,
    feature: str = "sum_quality",
    logistic_link: bool = False,
) -> DataFrame:
    """Adds ``prediction``; with ``logistic_link`` the link value goes through the logistic
    whatever the model's own link is."""
    known = df.filter(F.col(feature).isNotNull())
    scored = model.transform(_featured(known, [feature])).drop("features")
    if logistic_link:
        scored = scored.withColumn("prediction", logistic(F.col("link_value")))
    return scored.drop("link_value")


def save_model(model: GeneralizedLinearRegressionModel, path: str) -> None:
    """Write a fitted model."""
    model.write().overwrite().save(path)


def load_model(path: str) -> GeneralizedLinearRegressionModel:
    """Read a fitted model."""
    return GeneralizedLinearRegressionModel.load(path)


# -- regression of control -----------------------------------------------------------------


def pc_training_set(
    control: DataFrame, tracking: DataFrame, plays: DataFrame, floor: float = 0.1
) -> DataFrame:
    """Cells of at least ``floor`` control with the carrier's recorded position:
    x, y, x_car, y_car, PC, and the frame they belong to.

    Carriers are found by one join of the tracking rows with the plays; only they meet the cells.
    Cells that are partitioned by frame stay where they are and are not sorted.
    """
    strong = control.filter(F.col("PC") >= floor)
    carriers = plays.select(*PLAY, F.col("ballCarrierId").alias("nflId"))
    located = (
        tracking.join(carriers, PLAYER_PLAY)
        .select(
            F.col("gameId").alias("game"),
            F.col("playId").alias("play"),
            F.col("frameId").alias("frame"),
            F.col("x").alias("x_car"),
            F.col("y").alias("y_car"),
        )
    )
    placed = located.repartition(fan_out(tracking.sparkSession), *CELL_FRAME).hint("shuffle_hash")
    return strong.join(placed, CELL_FRAME, "left").select(
        *CELL_FRAME, "x", "y", "x_car", "y_car", "PC"
    )


INPUTS = ("x", "y", "x_car", "y_car")


SPLIT_KEYS = [*CELL_FRAME, "x", "y"]
# Ranges of control in which the bounds of its quantiles are looked for.
PC_BUCKETS = 2**14


def settled_for_split(df: DataFrame, seed: int = 12) -> DataFrame:
    """A control training set stored with a byte of the hash of its keys, for :func:`pc_split` with the
    same seed: rows are ranked, cut and split, and none of these passes spreads or hashes all of them
    again. Hashes do not compress, so a whole one would be as long as all that a row has besides."""
    return settle(df.withColumn("_key_prefix", key_prefix(SPLIT_KEYS, seed)), "zstd")


def pc_split(df: DataFrame, share: float = 0.8, seed: int = 12, groups: int | None = 5) -> DataFrame:
    """The rows of a control training set with ``is_train``, balanced over ranges of ``PC``.

    A table that has ``is_train`` already keeps it.
    """
    if "is_train" in df.columns:
        return df
    known = df.filter(F.col("x_car").isNotNull() & F.col("PC").isNotNull())
    stored = "_key_prefix" if "_key_prefix" in df.columns else None
    groups = groups or 2  # two bounds are one stratum
    # Control lies between 0 and 1; a value that does not only makes the buckets less even.
    bucket = F.when(F.isnan("PC"), F.lit(2**62)).otherwise(F.floor(F.col("PC") * PC_BUCKETS))
    split = stratified_split(known, "PC", share, SPLIT_KEYS, seed, groups=groups, prefixed_as=stored, bucket=bucket)
    return split.drop("_key_prefix")


@dataclass(frozen=True)
class StoppedFit:
    """A regressor at its best round, and how it got there."""

    model: GBTRegressionModel
    best_round: int
    rounds: int
    errors: tuple[float, ...]


def stop_round(errors: Sequence[float], patience: int) -> tuple[int, int] | None:
    """The best round and the round at which ``patience`` rounds have brought nothing better,
    counted from 1; nothing while the last improvement is more recent."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            return best + 1, k + 1
    return None


def fit_with_patience(
    df: DataFrame, share: float = 0.8, seed: int = 12, most_rounds: int = 50, patience: int = 10, depth: int = 5
) -> StoppedFit:
    """Boosted trees of ``PC`` that stop when the held-out error has not improved for ``patience``
    rounds, and keep the state of the best round.

    The error of every round is the mean absolute one on the rows that are not for training. Rounds
    are tried in lots that double, and a round is the same however many follow it; so the model of
    the best round is the one fitted with just as many.
    """
    split = pc_split(df, share, seed)
    data = settle(_featured(split.select(*INPUTS, "PC", "is_train"), INPUTS).select("features", "PC", "is_train"))
    train, held = data.filter("is_train"), data.filter("not is_train")

    def fit(rounds: int) -> GBTRegressionModel:
        return GBTRegressor(
            featuresCol="features", labelCol="PC", lossType="absolute", maxIter=rounds, maxDepth=depth, seed=seed
        ).fit(train)

    rounds = min(most_rounds, patience + 2)
    while True:
        model = fit(rounds)
        errors = tuple(model.evaluateEachIteration(held, "absolute"))
        stopped = stop_round(errors, patience)
        if stopped or rounds == most_rounds:
            break
        rounds = min(most_rounds, 2 * rounds)
    best, last = stopped or (errors.index(min(errors)) + 1, rounds)
    return StoppedFit(model if best == rounds else fit(best), best, last, errors[:last])


# Ranges of an input that trees tell apart, and how far a round follows its tree: defaults of Spark ML.
BINS, STEP, TOLERANCE = 32, 0.1, 0.01


def fit_pc_regressor(
    df: DataFrame,
    share: float = 0.8,
    seed: int = 12,
    iterations: int = 20,
    depth: int = 5,
) -> GBTRegressionModel:
    """Boosted trees of ``PC`` on the cell and the carrier, absolute loss, stopped early on the
    held-out part.

    All rows take part, but they are neither copied nor cached, as ``GBTRegressor`` does: like there an
    input is only cut at some thirty places (:func:`_input_cuts`), so the rows between the same cuts
    have the same prediction, and a tree follows from their number and their mean residual. A round
    reads the table once, so it should be a stored one (:func:`~yardgrid.session.settle`); its tree is
    Spark ML's on at most a million weighted rows. Rounds, step and the rule for stopping are those of
    ``GBTRegressor``.
    """
    rows = pc_split(df, share, seed).select(*INPUTS, "PC", "is_train").filter(F.col("is_train").isNotNull())
    points = _input_points(rows.filter("is_train"))
    rows = _placed(rows, points).select("place", "PC", "is_train")
    seen = rows.groupBy("place").agg(
        F.count_if("is_train").alias("n"),
        F.count_if(~F.col("is_train")).alias("n_held"),
        F.sum(F.when(F.col("is_train"), F.col("PC"))).alias("total"),
    )
    places = settle(_featured(seen.select("*", *_inputs_of(points)), INPUTS).drop(*INPUTS))
    held = places.agg(F.sum("n_held")).first()[0]
    if not held:
        raise ValueError("no held-out rows to stop on")

    def fit(residual: Column, table: DataFrame, round_: int) -> DecisionTreeRegressionModel:
        data = table.filter("n > 0").select("features", residual.alias("residual"), F.col("n").cast("double"))
        # So many bins that all places are read for the cuts; there are no more than BINS for an input.
        tree = DecisionTreeRegressor(
            featuresCol="features", labelCol="residual", weightCol="n", maxDepth=depth, maxBins=BINS**2, seed=seed + round_
        )
        return tree.fit(data)

    trees = [fit(F.col("total") / F.col("n"), places, 0)]
    guessed = places.drop("total").withColumn("guess", F.lit(0.0))
    best = None
    while True:
        step = 1.0 if len(trees) == 1 else STEP
        scored = trees[-1].transform(guessed)
        guessed = settle(scored.withColumn("guess", F.col("guess") + step * F.col("prediction")).drop("prediction"))
        met = rows.join(F.broadcast(guessed.select("place", "guess")), "place")
        judged = settle(
            met.groupBy("place").agg(
                F.count_if(F.col("is_train") & (F.col("PC") >= F.col("guess"))).alias("above"),
                F.sum(F.when(~F.col("is_train"), F.abs(F.col("PC") - F.col("guess")))).alias("error"),
            )
        )
        error = judged.agg(F.sum("error")).first()[0] / held
        if best and best[0] - error < TOLERANCE * max(error, 0.01):
            trees = trees[: best[1]]
            break
        best = (error, len(trees))
        if len(trees) == iterations:
            break
        # The absolute loss has 1 for a row above its prediction and -1 for one below.
        mean = (2 * F.col("above") - F.col("n")) / F.col("n")
        trees.append(fit(mean, guessed.join(judged.select("place", "above"), "place"), len(trees)))
    return _boosted(df.sparkSession, trees)


def _input_points(rows: DataFrame) -> list[list[float]]:
    """At most ``BINS`` ascending values of each input: quantiles in the middle of equal shares."""
    shares = [(i + 0.5) / BINS for i in range(BINS)]
    found = rows.agg(*[F.percentile_approx(c, shares, 100 * BINS).alias(c) for c in INPUTS]).first()
    if found[0] is None:
        raise ValueError("no rows to fit on")
    points: list[list[float]] = []
    for values in found:
        kept: list[float] = []
        for value in sorted(map(float, values)):
            if not kept or kept[-1] < (kept[-1] + value) / 2.0 < value:  # a cut fits between them
                kept.append(value)
        points.append(kept)
    return points


def _input_cuts(points: Sequence[float]) -> list[float]:
    """Places halfway between neighbouring points, where Spark ML cuts an input of these values."""
    return [(a + b) / 2.0 for a, b in zip(points, points[1:])]


def _placed(rows: DataFrame, points: Sequence[Sequence[float]]) -> DataFrame:
    """Adds ``place``, the number of a row's place in the grid between the cuts of all inputs; a
    missing input fails the job.

    A value at a cut belongs below it, as in a tree; ranges of ``Bucketizer`` begin with their first
    value, so they begin with the next number. An input of one point has no cut, but a range needs one.
    """
    splits = [[-math.inf, *[math.nextafter(c, math.inf) for c in _input_cuts(v) or [1e308]], math.inf] for v in points]
    ranges = [f"_{name}_range" for name in INPUTS]
    found = Bucketizer(splitsArray=splits, inputCols=list(INPUTS), outputCols=ranges).transform(rows)
    place = reduce(lambda so_far, name: so_far * BINS + F.col(name), ranges, F.lit(0.0)).cast("int")
    missing = F.raise_error(F.lit("an input of the regression is missing")).cast("int")
    return found.withColumn("place", F.coalesce(place, missing)).drop(*ranges)


def _inputs_of(points: Sequence[Sequence[float]]) -> list[Column]:
    """The points of a place, under the names of the inputs."""
    columns = []
    for k, (name, values) in enumerate(zip(INPUTS, points)):
        digit = (F.shiftright("place", 5 * (len(INPUTS) - 1 - k)) % BINS).cast("int")
        columns.append(F.get(F.array(*[F.lit(v) for v in values]), digit).alias(name))
    return columns


def _boosted(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel]) -> GBTRegressionModel:
    """The trees as one model: the first one and a step along each of the others."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.org.apache.spark.ml.regression
    members, weights = new_array(kind.DecisionTreeRegressionModel, len(trees)), new_array(jvm.double, len(trees))
    for k, tree in enumerate(trees):
        members[k], weights[k] = tree._java_obj, 1.0 if k == 0 else STEP
    model = GBTRegressionModel(kind.GBTRegressionModel(f"GBTRegressor_{uuid.uuid4().hex[-12:]}", members, weights))
    model.set(model.labelCol, "PC")
    model.set(model.lossType, "absolute")
    model._transfer_params_to_java()
    return model


def score_regressor(model: GBTRegressionModel, df: DataFrame) -> DataFrame:
    """Rows with a known control and carrier, and the ``prediction`` for them."""
    known = df.filter(F.col("x_car").isNotNull() & F.col("PC").isNotNull())
    return model.transform(_featured(known, INPUTS)).drop("features")


def evaluate_regressor(model: GBTRegressionModel, df: DataFrame) -> DataFrame:
    """Mean absolute and mean squared error of a regressor."""
    scored = score_regressor(model, df)
    errors = {
        name: RegressionEvaluator(labelCol="PC", metricName=name).evaluate(scored)
        for name in ("mae", "mse")
    }
    return df.sparkSession.createDataFrame(
        [(errors["mae"], errors["mse"])], "mae double, mse double"
    )
