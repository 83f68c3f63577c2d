"""Naive forecast: the counts of an earlier day, moved onto the forecast day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions.timefields import midnight, rebase
from gateflow.operators.flow import slot_flow
from gateflow.operators.grid import KEY, template


def naive_forecast(swipes: DataFrame, source_day: dt.date, forecast_day: dt.date, stations: DataFrame | None = None) -> DataFrame:
    """The day filter sits on the event time itself, so it reaches the scan.

    ``stations`` (stationID) is the template's list of stations; without it they are read off all swipes.
    """
    one_day = swipes.filter((F.col("time") >= midnight(source_day))
                            & (F.col("time") < midnight(source_day + dt.timedelta(days=1))))
    moved = one_day.withColumn("time", rebase(F.col("time"), (forecast_day - source_day).days))
    return (
        template(swipes if stations is None else stations, forecast_day).join(slot_flow(moved), KEY, "left")
        .na.fill(0, ["inNums", "outNums"])
        .select("stationID", "startTime", "endTime", "inNums", "outNums")
    )
