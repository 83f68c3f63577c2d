"""Forecast by the absolute loss: station, date, slot, weekday and period; shuffled balanced folds; medians in the leaves."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions.timefields import add_time_fields, days_since_first, service_band
from gateflow.operators import forecast, grid, model, staged
from gateflow.session import materialise

FEATURES = ["stationID", "date", "slot", "weekday", "period"]
LABELS = ("inNums", "outNums")
KEYS = ["stationID", "day", "slot"]


def feature_table(dense: DataFrame, first_day: dt.date, forecast_day: dt.date, folds: int) -> tuple[DataFrame, DataFrame]:
    """Assembled rows of the days before the forecast day with their ``fold``, and those of the forecast day."""
    rows = add_time_fields(dense).withColumns({"date": days_since_first(F.col("day"), F.lit(first_day)),
                                               "period": service_band(F.col("hour"))})
    rows = staged.assembled(rows, FEATURES).select(*KEYS, "_features", *LABELS)
    known = model.balanced_folds(rows.filter(F.col("day") < F.lit(forecast_day)), KEYS, folds)
    return materialise(known, "absolute"), rows.filter(F.col("day") == F.lit(forecast_day))


def fits(known: DataFrame, setting: model.Boosting, folds: int) -> dict[tuple[str, int], staged.Staged]:
    """One chain per label and fold, which stops on the rows of its own fold."""
    jobs = [(label, i) for label in LABELS for i in range(folds)]
    chains = model.side_by_side([
        lambda c=c, i=i: staged.fit(known.withColumn("_own", F.col("fold") == i), c, setting, "_own") for c, i in jobs], 8)
    return dict(zip(jobs, chains))


def absolute_forecast(dense: DataFrame, first_day: dt.date, forecast_day: dt.date, setting: model.Boosting, folds: int = 15,
                      closed: Sequence[int] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forecast, a row per fit (rounds fitted, best round, error of its own fold), and a row per fit that compares every
    leaf with the median of its rows."""
    known, ahead = feature_table(dense, first_day, forecast_day, folds)
    chains = fits(known, setting, folds)
    parts = [reduce(lambda df, c: chains[c, i].predict(df, f"{c}_pred"), LABELS, ahead).select(*KEYS, *[f"{c}_pred" for c in LABELS])
             for i in range(folds)]
    mean = reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(*[F.avg(f"{c}_pred").alias(c) for c in LABELS])
    out = forecast.submission(grid.template(dense, forecast_day), mean, closed=closed)
    rounds = known.sparkSession.createDataFrame(
        [(label, i, len(c.trees), c.best, c.losses[c.best - 1]) for (label, i), c in chains.items()],
        "label STRING, fold INT, rounds INT, best INT, mae DOUBLE")  # a row per fit, from the models
    checks = [staged.leaf_check(c, known.filter(F.col("fold") != i), label).withColumns({"label": F.lit(label), "fold": F.lit(i)})
              for (label, i), c in chains.items()]
    leaves = reduce(DataFrame.unionByName, checks).groupBy("label", "fold", "round").agg(
        F.sum("rows").alias("rows"), F.count_if(F.col("value") != F.col("median")).alias("wrong"))
    leaves = leaves.groupBy("label", "fold").agg(F.max("rows").alias("most_rows"), F.min("rows").alias("least_rows"), F.sum("wrong").alias("wrong"))
    return out, rounds, leaves
