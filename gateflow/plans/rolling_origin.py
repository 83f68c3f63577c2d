"""Rolling-origin forecast: dense business days, group statistics and lags of one to three days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions.numeric import half_even
from gateflow.functions.timefields import add_time_fields, business_index, weekday
from gateflow.operators import flow, forecast, grid, history, model, selection, stats
from gateflow.session import materialise

FAMILY = {"ID_dh": ["stationID", "week", "hour"], "ID_d": ["stationID", "week"], "ID": ["stationID"]}


def feature_table(swipes: DataFrame, first_day: dt.date, forecast_day: dt.date, holidays: Sequence[dt.date],
                  origin: dt.date, known_until: dt.date) -> tuple[DataFrame, list[str]]:
    """Lagged flows and lagged statistics of business days; near-constant columns are left out.

    Statistics only see days before ``known_until``, so no fold reads its own future.
    """
    rows = materialise(flow.slot_flow(swipes), "flow")
    dense = grid.densify(rows, grid.grid(rows, first_day, forecast_day))
    dense = add_time_fields(dense).withColumn("week", weekday(F.col("day"), 1)).drop("weekday")
    known = dense.filter(F.col("day") < F.lit(known_until))
    dense = stats.add_group_family(dense, known, FAMILY)
    dense = grid.business_days(dense, holidays).withColumn(
        "businessIndex", business_index(F.col("day"), holidays, origin))
    dense = materialise(dense, "dense")
    statistics = [c for c in dense.columns if c.startswith(("inNums_ID", "outNums_ID"))]
    dense, dropped = selection.drop_quasi_constant(dense, statistics)
    kept = [c for c in statistics if c not in dropped]
    lagged = history.business_day_lags(dense, ["inNums", "outNums", *kept]).drop(*kept)
    names = ["stationID", "week", "hour", "minute"] + [c for c in lagged.columns if "_lag_" in c]
    return lagged, names


def rolling_errors(table: DataFrame, names: Sequence[str], valid_days: Sequence[int],
                   setting: model.Boosting) -> DataFrame:
    """Errors of both targets per fold; average them for the cross-validated error."""
    splits = model.rolling_splits(valid_days)
    both = model.side_by_side([
        lambda c=c: model.rolling_origin(table, splits, names, c, setting) for c in ("inNums", "outNums")])
    return both[0].unionByName(both[1])


def final_forecast(table: DataFrame, names: Sequence[str], test_index: int, forecast_day: dt.date,
                   setting: model.Boosting, closed: Sequence[int] = ()) -> DataFrame:
    test, known = table.filter(F.col("businessIndex") == test_index), table.filter(F.col("businessIndex") < test_index)
    for label in ("inNums", "outNums"):
        test = model.predict(model.fit(known, names, label, setting), test, f"{label}_pred")
    out = test.select("stationID", "day", "slot", half_even(F.col("inNums_pred")).alias("inNums"),
                      half_even(F.col("outNums_pred")).alias("outNums"))
    return forecast.submission(grid.template(table, forecast_day), out, closed=closed)
