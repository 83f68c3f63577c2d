"""Wide five-day forecast: the last five days side by side, neighbour slots, cross-fitted."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions.numeric import truncate
from gateflow.operators import forecast, grid, history, model
from gateflow.session import materialise


def feature_table(dense: DataFrame, label_days: Sequence[dt.date]) -> DataFrame:
    """Five days back per label day, each with its neighbour slots, and the label where it is known."""
    wide = history.last_days_wide(dense, label_days)
    columns = [f"{side}{i}" for i in range(1, 6) for side in ("In", "out")]
    wide = history.neighbour_slots(wide, columns, keys=("stationID", "labelDay"))
    labels = dense.select("stationID", F.col("day").alias("labelDay"), "slot", F.col("inNums").alias("labelin"),
                          F.col("outNums").alias("labelout"))
    return wide.join(labels, ["stationID", "labelDay", "slot"], "left").withColumnRenamed("labelDay", "day")


def wide_days_forecast(dense: DataFrame, label_days: Sequence[dt.date], forecast_day: dt.date,
                       setting: model.Boosting, folds: int = 5, closed: Sequence[int] = ()) -> tuple[DataFrame, DataFrame]:
    """Forecast, and the out-of-fold errors per label and fold.

    ``label_days`` are earlier days of the same kind; the forecast day is added to them.
    """
    table = materialise(feature_table(dense, [*label_days, forecast_day]), "features")
    names = [c for c in table.columns if c not in ("day", "labelin", "labelout")]
    ahead = F.col("day") == F.lit(forecast_day)
    _, scored, errors = model.stack(table.filter(~ahead), table.filter(ahead), names, ["labelin", "labelout"], setting,
                               folds, categorical=["stationID"])
    out = scored.select("stationID", "day", "slot", truncate(F.col("labelin_pred")).alias("inNums"),
                        truncate(F.col("labelout_pred")).alias("outNums"))
    return forecast.submission(grid.template(table, forecast_day), out, closed=closed), errors
