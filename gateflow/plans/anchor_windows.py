"""Multi-anchor forecast: trailing windows, cross-fitting per label span, blend, night override."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.operators import forecast, grid, model, stats, trailing
from gateflow.session import materialise

NOT_FEATURES = ("day", "slot", "stationID", "businessIndex", "anchor", "inNums", "outNums")


def span_forecast(rows: DataFrame, cells: DataFrame, span: int, test_index: int, setting: model.Boosting, folds: int,
                  windows: Sequence[int], spec: dict) -> tuple[DataFrame, DataFrame]:
    """Forecast of one label span and its cross-validated errors."""
    known = rows.filter(F.col("businessIndex") < test_index)
    options = {"windows": windows, "spec": spec}
    train = materialise(trailing.anchor_training_set(known, span, test_index, **options), "anchors")
    test = trailing.add_trailing_stats(cells.withColumn("anchor", F.lit(test_index)), known, [test_index], **options)
    names = [c for c in train.columns if c not in NOT_FEATURES]
    _, scored, errors = model.stack(train, test, names, ["inNums", "outNums"], setting, folds)
    out = scored.select("stationID", "day", "slot", F.col("inNums_pred").alias("inNums"),
                        F.col("outNums_pred").alias("outNums"))
    return forecast.clip_forecast(out, 0.0, 5000.0), errors.withColumn("span", F.lit(span))


def anchor_forecast(rows: DataFrame, cells: DataFrame, spans: Sequence[int], test_index: int, forecast_day: dt.date,
                    setting: model.Boosting, folds: int = 10, windows: Sequence[int] = (1, 3, 5, 10, 15),
                    spec: dict | None = None, closed: Sequence[int] = ()) -> tuple[DataFrame, DataFrame]:
    """Blend over the label spans, and the out-of-fold errors per span, label and fold.

    Night slots come from the history of non-zero days.
    """
    spec = spec or trailing.DEFAULT_SPEC
    parts = model.side_by_side([
        lambda s=s: span_forecast(rows, cells, s, test_index, setting, folds, windows, spec) for s in spans])
    night = stats.night_profile(rows.filter(F.col("businessIndex") < test_index)).select(
        "stationID", "slot", F.col("mean_in").alias("night_in"), F.col("mean_out").alias("night_out"))
    blended = forecast.blend([part for part, _ in parts])
    return (forecast.submission(grid.template(cells, forecast_day), blended, night, closed),
            reduce(DataFrame.unionByName, [errors for _, errors in parts]))
