"""Boosted-tree forecasting on Spark ML: fit, refit, folds, per-type models, importance."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateflow.session import materialise, shared_folder

T = TypeVar("T")

# Published training settings (rate, leaves or depth, rounds, patience, row share).
PUBLISHED = {
    "total-flow": {"rate": 0.01, "leaves": 65, "rounds": 10000, "patience": 200, "rows": 0.9},
    "baseline": {"rate": 0.01, "leaves": 63, "rounds": 10000, "patience": 200, "rows": 0.9},
    "anchors": {"rate": 0.08, "leaves": 63, "rounds": 200000, "patience": 500, "rows": 0.9},
    "one-day-slip": {"rate": 0.01, "leaves": 63, "rounds": 100000, "patience": 500, "rows": 0.6},
    "wide-days": {"rate": 0.02, "leaves": 30, "depth": 5, "rounds": 20000, "patience": 100, "rows": 0.85,
                  "min_rows": 20},
    "rolling-origin": {"rate": 0.004, "depth": 11, "rounds": 10000, "patience": 100, "rows": 0.8},
    "absolute-loss": {"rate": 0.1, "leaves": 13, "rounds": 10000, "patience": 500, "rows": 0.3, "min_rows": 80},
}


@dataclass(frozen=True)
class Boosting:
    """Settings of one boosted regression."""

    rounds: int = 60
    rate: float = 0.1
    depth: int = 5
    rows: float = 0.9
    min_rows: int = 1
    loss: str = "squared"
    patience: int = 10
    bins: int = 64
    seed: int = 1

    @staticmethod
    def preset(name: str, **changes) -> "Boosting":
        """A published setting as it is; ``changes`` name what shall differ. Thousands of rounds at a rate of 0.01 are
        as many sequential jobs on a cluster, so rounds and rate are what one usually changes."""
        p = PUBLISHED[name]
        published = Boosting(rounds=p["rounds"], rate=p["rate"], depth=p.get("depth") or math.ceil(math.log2(p["leaves"])),
                             rows=p["rows"], min_rows=p.get("min_rows", 1), patience=p["patience"],
                             loss="absolute" if name == "absolute-loss" else "squared")
        return replace(published, **changes)


def side_by_side(jobs: Sequence[Callable[[], T]], threads: int = 4) -> list[T]:
    """Run independent fits at the same time: each is a chain of short Spark jobs that alone would
    leave most of the cluster idle."""
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(SparkSession.active())(j)) for j in jobs]]


def fit(df: DataFrame, features: Sequence[str], label: str, setting: Boosting, categorical: Sequence[str] = (),
        weight: str | None = None) -> PipelineModel:
    """Assemble the features and fit one model; missing features count as 0."""
    shared_folder(df.sparkSession)  # long boosting chains are checkpointed there
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_code", handleInvalid="keep", stringOrderType="alphabetAsc")
                for c in categorical]
    inputs = [f"{c}_code" if c in categorical else c for c in features]
    bins = setting.bins
    if categorical:
        kinds = df.agg(*[F.count_distinct(c).alias(c) for c in categorical]).first()
        bins = max(bins, max(kinds) + 1)  # every category needs its own bin
    options = {"weightCol": weight} if weight else {}
    tree = GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="prediction", maxIter=setting.rounds,
        stepSize=setting.rate, maxDepth=setting.depth, subsamplingRate=setting.rows, maxBins=bins,
        minInstancesPerNode=setting.min_rows, lossType=setting.loss, seed=setting.seed, checkpointInterval=10, **options)
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[*indexers, assembler, tree]).fit(df.na.fill(0, list(features)))


def predict(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Prediction as column ``name``; missing features are 0 in the result as well."""
    inputs = [c for c in model.stages[-2].getInputCols() if c in df.columns]
    codes = [s.getOutputCol() for s in model.stages[:-2]]
    return model.transform(df.na.fill(0, inputs)).drop("features", *codes).withColumnRenamed("prediction", name)


def best_rounds(model: PipelineModel, valid: DataFrame, setting: Boosting) -> int:
    """Round with the lowest validation loss, searched until ``patience`` rounds bring no gain."""
    tree = model.stages[-1]
    ready = valid.na.fill(0, [c for c in model.stages[-2].getInputCols() if c in valid.columns])
    for stage in model.stages[:-1]:
        ready = stage.transform(ready)
    best, at = math.inf, 0
    for i, loss in enumerate(tree.evaluateEachIteration(ready, setting.loss)):
        if loss < best:
            best, at = loss, i
        elif i - at >= setting.patience:
            break
    return at + 1


def fit_refit(train: DataFrame, valid: DataFrame, everything: DataFrame, features: Sequence[str], label: str,
              setting: Boosting, **options) -> tuple[PipelineModel, PipelineModel]:
    """Fit with early stopping, then fit all rows with the number of rounds found."""
    first = fit(train, features, label, setting, **options)
    rounds = best_rounds(first, valid, setting)
    return first, fit(everything, features, label, replace(setting, rounds=rounds), **options)


def day_slices(df: DataFrame, valid, test, day: str = "day") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows before the validation day, on it, and on the test day."""
    c = F.col(day)
    return df.filter(c < F.lit(valid)), df.filter(c == F.lit(valid)), df.filter(c == F.lit(test))


def fold_of(keys: Sequence[str], k: int, seed: int = 0) -> Column:
    """Fold by hashed key: the same row lands in the same fold whatever the partitioning."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(k)).cast("int")


def ranked(df: DataFrame, keys: Sequence[str], seed: int, name: str) -> DataFrame:
    """Rows with their exact rank from 0 by a seeded hash of the keys; ties of the hash are put in order by the keys.

    Rows are dealt by ranges of the hash; the counts of the ranges tell each one the rank it starts at, so ranks are
    exact without a sort in one task.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.lit(str(seed)))
    order = ["_hash", *keys]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.withColumn("_hash", F.md5(text.cast("binary"))).repartitionByRange(parts, *order)
                        .withColumn("_part", F.spark_partition_id()), "ranked")
    held = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_held"))  # a row per range
    before = held.select("_part", (F.sum("_held").over(Window.orderBy("_part")) - F.col("_held")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (dealt.withColumn("_inside", inside).join(F.broadcast(before), "_part")
            .withColumn(name, F.col("_before") + F.col("_inside")).drop("_hash", "_part", "_inside", "_before"))


def balanced_folds(df: DataFrame, keys: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """Shuffled folds whose sizes differ by one row at most: ``fold`` is the rank by a seeded hash, modulo ``k``."""
    return ranked(df, keys, seed, "_rank").withColumn("fold", (F.col("_rank") % F.lit(k)).cast("int")).drop("_rank")


def arithmetic_fold(k: int) -> Column:
    """Fold from station, business day and slot by plain arithmetic."""
    return ((F.col("stationID") * 31 + F.col("businessIndex") * 7 + F.col("slot")) % F.lit(k)).cast("int")


def assembled(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()) -> tuple[PipelineModel, DataFrame, int]:
    """(stages, stored rows, categories): rows with their feature vector, put together once for any number of fits."""
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_code", handleInvalid="keep", stringOrderType="alphabetAsc")
                for c in categorical]
    assembler = VectorAssembler(inputCols=[f"{c}_code" if c in categorical else c for c in features], outputCol="features", handleInvalid="keep")
    filled = df.na.fill(0, list(features))
    stages = Pipeline(stages=[*indexers, assembler]).fit(filled)
    return stages, materialise(stages.transform(filled), "assembled"), max([len(s.labels) for s in stages.stages[:-1]], default=0)


def fit_vectors(rows: DataFrame, label: str, setting: Boosting, categories: int = 0):
    """One model on rows from ``assembled``."""
    shared_folder(rows.sparkSession)
    return GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="prediction", maxIter=setting.rounds, stepSize=setting.rate,
        maxDepth=setting.depth, subsamplingRate=setting.rows, maxBins=max(setting.bins, categories + 1), minInstancesPerNode=setting.min_rows,
        lossType=setting.loss, seed=setting.seed, checkpointInterval=10).fit(rows)


def stack(train: DataFrame, test: DataFrame, features: Sequence[str], labels: Sequence[str], setting: Boosting, k: int = 5,
          categorical: Sequence[str] = (), keys: Sequence[str] = ("stationID", "day", "slot"), fold: Column | None = None,
          threads: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cross-fit every label: out-of-fold forecasts of the training rows (``<label>_pred``, with their ``fold``), the mean
    forecast of the folds per key of the test rows, and the mean absolute error per label and fold.

    Rows are assembled and stored once; the fits of all folds and labels share them and run side by side. Folds are
    scored apart and averaged by key, so no plan holds more than one fold's trees per label.
    """
    train = train.withColumn("fold", fold if fold is not None else fold_of(keys, k))
    stages, ready, categories = assembled(train, features, categorical)
    ahead = stages.transform(test.na.fill(0, [c for c in features if c in test.columns])).select(*keys, "features")
    models = side_by_side([
        lambda i=i, c=c: fit_vectors(ready.filter(F.col("fold") != i), c, setting, categories) for i in range(k) for c in labels], threads)
    known, future = [], []
    for i in range(k):
        part, later = ready.filter(F.col("fold") == i), ahead
        for at, c in enumerate(labels):
            name, m = f"{c}_pred", models[i * len(labels) + at]
            part = m.transform(part).withColumnRenamed("prediction", name)
            later = m.transform(later).withColumnRenamed("prediction", name)
        known.append(part.drop("features"))
        future.append(later.select(*keys, *[f"{c}_pred" for c in labels]))
    oof = materialise(reduce(DataFrame.unionByName, known).drop(*[f"{c}_code" for c in categorical]), "out-of-fold")
    mean = reduce(DataFrame.unionByName, future).groupBy(*keys).agg(*[F.avg(f"{c}_pred").alias(f"{c}_pred") for c in labels])
    gaps = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.abs(F.col(c) - F.col(f"{c}_pred")).alias("gap")) for c in labels]))
    scores = oof.select("fold", gaps.alias("g")).groupBy("fold", "g.label").agg(F.avg("g.gap").alias("mae"))
    return oof, mean, scores


def per_type(train: DataFrame, test: DataFrame, domain: Sequence, column: str,
             fitted: Callable[[DataFrame, DataFrame], DataFrame], keys: Sequence[str],
             predictions: Sequence[str]) -> DataFrame:
    """One model per value of ``column``; the predictions of a key are summed over the values."""
    parts = side_by_side([
        lambda v=v: fitted(train.filter(F.col(column) == v), test.filter(F.col(column) == v)) for v in domain])
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(p).alias(p) for p in predictions])


def rolling_splits(business_indices: Sequence[int], next_day: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """(validation, test) day pairs: validate on each day, test on the business day after it."""
    return [(d, (next_day or {}).get(d, d + 1)) for d in business_indices]


def rolling_origin(rows: DataFrame, splits: Sequence[tuple[int, int]], features: Sequence[str], label: str,
                   setting: Boosting, index: str = "businessIndex") -> DataFrame:
    """Errors per fold: stop early on the validation day, refit up to it, test on the following day."""
    def one(valid_day: int, test_day: int) -> DataFrame:
        train, valid, test = day_slices(rows, valid_day, test_day, index)
        _, model = fit_refit(train, valid, rows.filter(F.col(index) <= valid_day), features, label, setting)
        scored = predict(model, test, "_pred")
        return scored.agg(F.avg(F.abs(F.col(label) - F.abs(F.rint("_pred")))).alias("mae")).select(
            F.lit(label).alias("label"), F.lit(valid_day).alias("validDay"), F.lit(test_day).alias("testDay"), "mae")

    return reduce(DataFrame.unionByName, side_by_side([lambda s=s: one(*s) for s in splits]))


def importance(models: Sequence[PipelineModel]) -> DataFrame:
    """Feature importance averaged over models. One small row per feature, built from the models."""
    spark, rows = SparkSession.active(), []
    for m in models:
        values = m.stages[-1].featureImportances.toArray()
        rows += [(name, float(v)) for name, v in zip(m.stages[-2].getInputCols(), values)]
    return (spark.createDataFrame(rows, "feature STRING, importance DOUBLE")
            .groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature"))


def select_by_importance(table: DataFrame, least: float) -> list[str]:
    """Names of the features above a threshold; the table has one row per feature."""
    return [r["feature"] for r in table.filter(F.col("importance") > least).collect()]


def distance_weight(index: str = "businessIndex", anchor: str = "anchor", half_life: float | None = None) -> Column:
    """Sample weight by distance to the anchor: 1 everywhere, or halved every ``half_life`` days."""
    if half_life is None:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.abs(F.col(index) - F.col(anchor)) / F.lit(half_life))
