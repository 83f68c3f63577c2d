import random
import statistics

import pytest
from pyspark.sql import functions as F

from gateflow.operators import model, staged

SETTING = model.Boosting(rounds=5, rate=0.5, depth=3, patience=2, rows=1.0, loss="absolute", min_rows=5)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    data = [(k % 6, k % 20, k % 144, k // 144, float(k % 10 * 2 + k % 6 + (50 if rng.random() < 0.05 else 0) + rng.random()), float(k % 10)) for k in range(900)]
    df = spark.createDataFrame(data, "stationID INT, businessIndex INT, slot INT, day INT, y DOUBLE, x DOUBLE")
    return staged.assembled(df, ["x", "stationID"]).withColumn("late", F.col("businessIndex") >= 17).cache()


def mae(chain, df):
    return chain.predict(df, "p").agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0]


def test_leaves_are_medians(table):
    chain = staged.fit(table, "y", SETTING)
    checked = staged.leaf_check(chain, table, "y").collect()
    assert checked and all(r.value == r.median for r in checked)
    assert {r.round for r in checked} == {1, 2, 3, 4, 5}
    for k in range(1, 6):
        assert sum(r.rows for r in checked if r.round == k) == 900


def test_absolute_loss_withstands_outliers(table):
    robust = staged.fit(table, "y", SETTING)
    squared = staged.fit(table, "y", model.Boosting(rounds=5, rate=0.5, depth=3, rows=1.0, min_rows=5))
    assert mae(robust, table) < mae(squared, table)


def test_fit_stops_itself(table):
    setting = model.Boosting(rounds=40, rate=1.0, depth=5, patience=3, rows=1.0, loss="absolute")
    chain = staged.fit(table, "y", setting, "late")
    assert len(chain.trees) < 40 and len(chain.trees) - chain.best == 3
    assert min(chain.losses) == chain.losses[chain.best - 1]
    first, again = staged.fit_refit(table, table, "y", setting, "late")
    assert len(again.trees) == again.best == first.best


def test_losses_are_those_of_the_validation_rows(table):
    chain = staged.fit(table, "y", SETTING, "late")
    late = table.filter("late")
    for k, loss in enumerate(chain.losses, 1):
        assert loss == pytest.approx(chain.predict(late, "p", k).agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0])


@pytest.mark.parametrize("loss", ["absolute", "squared"])
def test_weights(table, loss):
    setting = model.Boosting(rounds=3, rate=0.5, depth=3, rows=1.0, loss=loss)

    def forecast(df, weight=None):
        return {tuple(r) for r in staged.fit(df, "y", setting, weight=weight).predict(table, "p").select("stationID", "x", "slot", F.round("p", 9)).collect()}

    assert forecast(table.withColumn("w", F.lit(1.0)), "w") == forecast(table)
    gone = table.withColumn("w", F.when(F.col("slot") % 3 == 0, 0.0).otherwise(1.0))
    assert forecast(gone, "w") == forecast(table.filter("slot % 3 <> 0"))
    assert forecast(gone, "w") != forecast(table)


@pytest.mark.parametrize("bins", [2, 64])
def test_weighted_medians(spark, bins):
    rng = random.Random(1)
    data = [(g, rng.choice([0.0, 1.0, 1.5, rng.uniform(-50, 50)]), 1.0) for g in range(4) for _ in range(rng.choice([1, 2, 99, 100]))]
    data += [(9, 5.0, 1.0), (9, 7.0, 1.0), (10, -3.0, 1.0), (10, -3.0, 1.0)]
    df = spark.createDataFrame(data, "g INT, x DOUBLE, w DOUBLE")
    assert staged.weighted_medians(df, "g", "x", "w", bins) == {g: statistics.median([x for i, x, _ in data if i == g]) for g in {d[0] for d in data}}
    heavy = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 5.0), (1, 9.0, 3.0)], "g INT, x DOUBLE, w DOUBLE")
    assert staged.weighted_medians(heavy, "g", "x", "w", bins) == {1: 2.0}
    assert staged.weighted_medians(heavy.filter("x > 9"), "g", "x", "w", bins) == {}


def test_no_rows(spark, table):
    chain = staged.fit(table.filter("y IS NULL"), "y", SETTING)
    assert chain.trees == [] and chain.predict(table, "p").agg(F.max("p")).first()[0] == 0


def test_balanced_folds(spark):
    df = spark.range(1003).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    one = model.balanced_folds(df, ["a", "b"], 15)
    sizes = [r["count"] for r in one.groupBy("fold").count().collect()]
    assert len(sizes) == 15 and max(sizes) - min(sizes) == 1 and sum(sizes) == 1003
    other = model.balanced_folds(df.repartition(3), ["a", "b"], 15)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert sorted(map(tuple, one.collect())) != sorted(map(tuple, model.balanced_folds(df, ["a", "b"], 15, seed=1).collect()))
