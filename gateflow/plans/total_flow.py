"""Total-flow forecast: expanding statistics and device features of the previous day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.constants import PAY_TYPES
from gateflow.functions.numeric import log_feature, ratio
from gateflow.functions.timefields import add_time_fields, days_since_first, midnight, weekday, weekend_flag
from gateflow.operators import flow, forecast, grid, history, model, network
from gateflow.session import materialise

TIME = ["stationID", "week", "weekend", "hour", "minute", "daySinceFirst"]
KEYS = ["stationID", "day", "slot"]


def base_features(devices: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Flow with per-day device counts, device load and log features, all from the flow per device."""
    rows = add_time_fields(devices.groupBy(*KEYS, *extra).agg(
        F.sum("inNums").alias("inNums"), F.sum("outNums").alias("outNums")))
    rows = flow.add_distinct_counts(rows, devices, "deviceID", {
        "dID_of_sID": ["stationID", "day"], "dID_of_sID_h": ["stationID", "day", "hour"],
        "dID_of_sID_hm": ["stationID", "day", "hour", "minute"]})
    rows = rows.join(flow.device_load_of_counts(devices), ["stationID", "day", "hour"], "left")
    return rows.withColumns({f"{c}_log": log_feature(F.col(c)) for c in ("inNums", "outNums")})


def feature_table(swipes: DataFrame, first_day: dt.date, forecast_day: dt.date, by_type: bool = False,
                  stations: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Label rows with the whole feature row of the day before; nothing of a row's own day is used.

    The swipes are read once, for the flow per device. A gate passes many riders in ten minutes, so
    that table is far smaller, and flow, distinct devices and device load all follow from it.
    """
    extra = ["payType"] if by_type else []
    past = swipes.filter(F.col("time") < midnight(forecast_day))
    devices = add_time_fields(materialise(flow.slot_flow(past, ["deviceID", *extra]), "devices"))
    rows = history.expanding_stats(base_features(devices, extra), _grains(extra))
    carried = [c for c in rows.columns if c not in (*KEYS, *extra, "weekday", "hour", "minute")]
    cells = grid.grid(devices, forecast_day, forecast_day)
    ahead = grid.per_pay_type(cells, PAY_TYPES) if by_type else cells
    rows = rows.drop("weekday", "hour", "minute").unionByName(ahead, allowMissingColumns=True)
    day = F.col("day")
    rows = rows.withColumn("dayIndex", days_since_first(day, F.lit(first_day)) + 1)
    rows = history.previous_day(rows, carried, keys=("stationID", "slot", *extra))
    rows = add_time_fields(rows).withColumns({
        "week": weekday(day, 1), "weekend": weekend_flag(day), "daySinceFirst": F.col("dayIndex") - 1,
        "ratio_p": ratio(F.col("inNums_p"), F.col("outNums_p"))})
    return network.enrich(rows.drop(*[c for c in carried if c not in ("inNums", "outNums")], "weekday"), stations, days)


def _grains(extra: Sequence[str]) -> dict[str, list[str]]:
    return {"h": ["stationID", "hour", *extra], "hm": ["stationID", "hour", "minute", *extra],
            "wh": ["stationID", "weekday", "hour", *extra], "whm": ["stationID", "weekday", "hour", "minute", *extra]}


def feature_names(table: DataFrame) -> list[str]:
    kinds = dict(table.dtypes)
    return [c for c in table.columns if c not in (*KEYS[1:], "dayIndex", "inNums", "outNums", "payType")
            and kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")]


def train(table: DataFrame, valid_day: dt.date, forecast_day: dt.date, first_day: dt.date,
          setting: model.Boosting) -> tuple[DataFrame, dict]:
    """Both targets: stop early on the validation day, refit, predict the forecast day."""
    names = feature_names(table)
    known = table.filter(F.col("day") != F.lit(first_day))
    fitting, valid, test = model.day_slices(known, valid_day, forecast_day)
    everything = known.filter(F.col("day") < F.lit(forecast_day))
    labels = ("inNums", "outNums")
    models = dict(zip(labels, model.side_by_side([
        lambda c=c: model.fit_refit(fitting, valid, everything, names, c, setting) for c in labels])))
    for label in labels:
        test = model.predict(models[label][1], test, f"{label}_pred")
    return test, models


def total_flow_forecast(swipes: DataFrame, first_day: dt.date, valid_day: dt.date, forecast_day: dt.date,
                        setting: model.Boosting, closed: Sequence[int] = (), stations: DataFrame | None = None,
                        days: DataFrame | None = None) -> DataFrame:
    table = materialise(feature_table(swipes, first_day, forecast_day, stations=stations, days=days), "features")
    test, _ = train(table, valid_day, forecast_day, first_day, setting)
    out = test.select(*KEYS, F.col("inNums_pred").alias("inNums"), F.col("outNums_pred").alias("outNums"))
    return forecast.submission(grid.template(table, forecast_day), out, closed=closed)


def pay_type_forecast(swipes: DataFrame, first_day: dt.date, valid_day: dt.date, forecast_day: dt.date,
                      setting: model.Boosting, closed: Sequence[int] = ()) -> DataFrame:
    """One pair of models per ticket type, forecasts summed per station and slot."""
    table = materialise(feature_table(swipes, first_day, forecast_day, by_type=True), "features")

    def one_type(known: DataFrame, ahead: DataFrame) -> DataFrame:
        test, _ = train(known.unionByName(ahead), valid_day, forecast_day, first_day, setting)
        return test.select(*KEYS, "inNums_pred", "outNums_pred")

    day = F.col("day")
    summed = model.per_type(table.filter(day < F.lit(forecast_day)), table.filter(day == F.lit(forecast_day)),
                            PAY_TYPES, "payType", one_type, KEYS, ["inNums_pred", "outNums_pred"])
    out = summed.withColumnsRenamed({"inNums_pred": "inNums", "outNums_pred": "outNums"})
    return forecast.submission(grid.template(table, forecast_day), out, closed=closed)
