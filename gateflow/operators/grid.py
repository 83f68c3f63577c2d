"""Calendar, dense grids and day sheets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateflow.constants import PAY_TYPES, SERVICE_START_MINUTE, SLOTS_PER_DAY
from gateflow.functions.timefields import is_business_day, slot_end, slot_start, weekend_flag

KEY = ["stationID", "day", "slot"]


def calendar(spark: SparkSession, first: dt.date, last: dt.date, holidays: Sequence[dt.date] = ()) -> DataFrame:
    """One row per day with weekday, weekend, holiday and dense business index.

    The window has no partition key; its input is the calendar itself, a few hundred rows a year.
    """
    day = F.col("day")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    days = days.withColumns({
        "weekday": F.weekday(day).cast("int"),
        "weekend": weekend_flag(day),
        "holiday": (day.isin(list(holidays)) if holidays else F.lit(False)).cast("int"),
        "_open": is_business_day(day, holidays),
    })
    rank = F.dense_rank().over(Window.partitionBy("_open").orderBy("day"))
    return days.withColumn("businessIndex", F.when(F.col("_open"), rank)).drop("_open")


def business_days(df: DataFrame, holidays: Sequence[dt.date] = (), day: str = "day") -> DataFrame:
    """Rows on working days only."""
    return df.filter(is_business_day(F.col(day), holidays))


def recover_day(df: DataFrame, cal: DataFrame, index: str = "businessIndex") -> DataFrame:
    """Real date of a business index."""
    lookup = cal.filter(F.col("businessIndex").isNotNull()).select(F.col("businessIndex").alias(index), "day")
    return df.join(lookup, index, "left")


def drop_first_day(df: DataFrame, first: dt.date) -> DataFrame:
    return df.filter(F.col("day") != F.lit(first))


def in_service(df: DataFrame, closed_stations: Sequence[int] = (), start_minute: int = SERVICE_START_MINUTE) -> DataFrame:
    """Open stations from the first service minute on."""
    out = df.filter(F.col("slot") * 10 >= start_minute)
    return out.filter(~F.col("stationID").isin(list(closed_stations))) if closed_stations else out


def grid(stations: DataFrame, first: dt.date, last: dt.date, slots: int = SLOTS_PER_DAY) -> DataFrame:
    """Every station, day and slot. Each station row generates its own cells, so nothing is crossed.

    Station days are spread over all cores before they grow into slots.
    """
    return (
        stations.select("stationID").distinct()
        .select("stationID", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
        .repartition(stations.sparkSession.sparkContext.defaultParallelism, "stationID", "day")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    )


def densify(flow: DataFrame, cells: DataFrame, columns: Sequence[str] = ("inNums", "outNums")) -> DataFrame:
    """Flow on every grid cell, zero where nothing was counted."""
    return cells.join(flow.select(*KEY, *columns), KEY, "left").na.fill(0, list(columns))


def per_pay_type(cells: DataFrame, domain: Sequence[int] = PAY_TYPES) -> DataFrame:
    """Repeat each row for every ticket type."""
    return cells.withColumn("payType", F.explode(F.array(*[F.lit(p) for p in domain])))


def template(stations: DataFrame, day: dt.date) -> DataFrame:
    """Forecast template: station, start and end of each slot of one day."""
    return grid(stations, day, day).withColumns({
        "startTime": slot_start(F.col("day"), F.col("slot")),
        "endTime": slot_end(F.col("day"), F.col("slot")),
    })


def mask_labels(df: DataFrame, day: dt.date, columns: Sequence[str] = ("inNums", "outNums")) -> DataFrame:
    """Blank the flow of one day, so that nothing can be learned from it."""
    return df.withColumns({c: F.when(F.col("day") != F.lit(day), F.col(c)) for c in columns})


def day_gap(index: str = "businessIndex", anchor: str = "anchor") -> Column:
    """Signed distance in days to the anchor: negative before it."""
    return F.col(index) - F.col(anchor)


def day_sheet(dense: DataFrame, stations: Sequence[int]) -> DataFrame:
    """Wide sheet: one row per day and slot, in and out columns per listed station."""
    wide = dense.groupBy("day", "slot").pivot("stationID", list(stations)).agg(
        F.sum("inNums").alias("in"), F.sum("outNums").alias("out"))
    names = {f"{s}_{side}": f"{label}_{s}_0" for s in stations for side, label in (("in", "In"), ("out", "out"))}
    return wide.withColumnsRenamed(names).na.fill(0)
