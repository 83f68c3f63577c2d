import datetime as dt

import pytest
from pyspark.sql import functions as F

from gateflow.operators import model

SMALL = model.Boosting(rounds=5, rate=0.3, depth=3, patience=2, rows=1.0)


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(600).select(
        (F.col("id") % 6).cast("int").alias("stationID"), (F.col("id") % 20 + 1).cast("int").alias("businessIndex"),
        (F.col("id") % 144).cast("int").alias("slot"), F.lit(dt.date(2024, 1, 1)).alias("day"),
        F.when(F.col("id") % 9 > 0, F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 4).cast("int").alias("kind"),
    ).withColumn("y", F.coalesce("x", F.lit(0.0)) * 2 + F.col("stationID")).cache()


def test_fit_beats_the_mean(table):
    m = model.fit(table, ["x", "stationID"], "y", SMALL, categorical=["stationID"])
    out = model.predict(m, table, "p")
    mean = table.agg(F.avg("y")).first()[0]
    error, base = out.agg(F.avg(F.abs(F.col("y") - F.col("p"))), F.avg(F.abs(F.col("y") - mean))).first()
    assert out.count() == 600 and error < 0.6 * base


def test_absolute_loss_and_weights(table):
    m = model.fit(table.withColumn("w", F.lit(1.0)), ["x"], "y", model.Boosting(rounds=3, depth=2, loss="absolute"), weight="w")
    assert model.predict(m, table, "p").filter("p IS NULL OR isnan(p)").count() == 0


def test_refit_uses_the_best_round(table):
    train, valid, test = model.day_slices(table, 19, 20, "businessIndex")
    assert train.count() + valid.count() + test.count() == 600
    first, second = model.fit_refit(train, valid, table, ["x", "stationID"], "y", SMALL)
    assert second.stages[-1].getNumTrees == model.best_rounds(first, valid, SMALL) <= 5
    names = [r.feature for r in model.importance([first, second]).collect()]
    assert names[0] == "x" and model.select_by_importance(model.importance([first]), 0.3) == ["x"]


def test_cross_fit_covers_every_row_once(table):
    oof, test, scores = model.stack(table, table.limit(10), ["x", "stationID"], ["y"], SMALL, k=3)
    assert oof.count() == 600 and test.count() == 10
    assert scores.count() == 3 and scores.filter("mae IS NULL").count() == 0


def test_folds_do_not_depend_on_partitioning(table):
    keys = ["stationID", "businessIndex", "slot"]
    a = table.withColumn("f", model.fold_of(keys, 4)).groupBy("f").count()
    b = table.repartition(7).withColumn("f", model.fold_of(keys, 4)).groupBy("f").count()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_per_type_sums_predictions(table):
    def constant(train, test):
        return test.withColumn("p", F.lit(1.0)).select("slot", "stationID", "p")

    got = model.per_type(table, table, range(4), "kind", constant, ["slot", "stationID"], ["p"])
    assert got.agg(F.sum("p")).first()[0] == 600


def test_rolling_origin(table):
    splits = model.rolling_splits([18, 19])
    assert splits == [(18, 19), (19, 20)] and model.rolling_splits([5], {5: 9}) == [(5, 9)]
    assert model.rolling_origin(table, splits, ["x"], "y", SMALL).filter("mae > 0").count() == 2


def test_presets_scale_rounds():
    s = model.Boosting.preset("anchors", rounds=40)
    assert (s.rounds, s.rate, s.depth, s.rows) == (40, 0.08, 6, 0.9)
    assert model.Boosting.preset("anchors").rounds == 200000
    assert model.Boosting.preset("absolute-loss").loss == "absolute"
    assert model.Boosting.preset("rolling-origin").depth == 11


def test_distance_weight(spark):
    df = spark.createDataFrame([(16, 21)], "businessIndex INT, anchor INT")
    assert df.select(model.distance_weight(half_life=5.0), model.distance_weight()).first()[:] == (0.5, 1.0)
