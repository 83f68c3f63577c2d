"""Forecast post-processing, blending, error metrics and the described baselines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateflow.constants import EARLY_HOURS_CAP, EARLY_HOURS_END, PROFILE_DAMPING
from gateflow.functions.numeric import clip, ratio
from gateflow.functions.timefields import hour_of, is_business_day, midnight
from gateflow.operators.grid import KEY
from gateflow.operators.stats import night_in, night_out

FLOWS = ("inNums", "outNums")


def onto_template(cells: DataFrame, forecast: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Forecast values on the template rows, matched by key; missing ones are 0."""
    return cells.join(forecast.select(*keys, *FLOWS), list(keys), "left").na.fill(0, list(FLOWS))


def clip_forecast(df: DataFrame, low: float = 0.0, high: float | None = None) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), low, high) for c in FLOWS})


def close_stations(df: DataFrame, closed: Sequence[int]) -> DataFrame:
    shut = F.col("stationID").isin(list(closed))
    return df.withColumns({c: F.when(shut, F.lit(0)).otherwise(F.col(c)) for c in FLOWS})


def night_override(df: DataFrame, night: DataFrame) -> DataFrame:
    """Replace night slots by another source (``night_in``, ``night_out`` per station and slot), 0 if it has none."""
    joined = df.join(night.select("stationID", "slot", F.col("night_in").alias("_in"), F.col("night_out").alias("_out")),
                     ["stationID", "slot"], "left")
    minute = F.col("slot") * 10
    return joined.withColumns({
        "inNums": F.when(night_in(minute), F.coalesce("_in", F.lit(0.0))).otherwise(F.col("inNums")),
        "outNums": F.when(night_out(minute), F.coalesce("_out", F.lit(0.0))).otherwise(F.col("outNums")),
    }).drop("_in", "_out")


def submission(cells: DataFrame, forecast: DataFrame, night: DataFrame | None = None, closed: Sequence[int] = (),
               high: float = 4000.0) -> DataFrame:
    """Template, forecast, night hours, closed stations and bounds in one result."""
    out = onto_template(cells, forecast)
    if night is not None:
        out = night_override(out, night)
    return clip_forecast(close_stations(out, closed), 0.0, high)


def blend(forecasts: Sequence[DataFrame], weights: Sequence[float] | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Weighted mean of forecasts per key, whatever the row order of each."""
    weights = list(weights or [1.0] * len(forecasts))
    stacked = reduce(DataFrame.unionByName, [
        f.select(*keys, *[F.col(c).cast("double").alias(c) for c in FLOWS], F.lit(float(w)).alias("_w"))
        for f, w in zip(forecasts, weights)])
    return stacked.groupBy(*keys).agg(*[(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in FLOWS])


def error_columns(truth: Column, predicted: Column) -> tuple[Column, Column]:
    """Absolute error and relative error per row; the latter is NULL when both are zero."""
    absolute = F.abs(truth - predicted).cast("double")
    return absolute, ratio(absolute, F.abs(truth + predicted))


def errors(df: DataFrame, pairs: dict[str, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute and mean relative error per (truth, prediction) pair."""
    aggs = []
    for name, (truth, predicted) in pairs.items():
        absolute, relative = error_columns(F.col(truth), F.col(predicted))
        aggs += [F.avg(absolute).alias(f"mae_{name}"), F.avg(relative).alias(f"relative_{name}")]
    return df.groupBy(*by).agg(*aggs)


def mean_over_folds(scores: DataFrame, by: Sequence[str] = ("label",), column: str = "mae") -> DataFrame:
    """Cross-validated error: plain mean of the fold errors."""
    return scores.groupBy(*by).agg(F.avg(column).alias(column))


def mean_of_days(dense: DataFrame, before: dt.date, days: int, holidays: Sequence[dt.date] = ()) -> DataFrame:
    """Forecast: mean of the last business days before a date."""
    chosen: list[dt.date] = []
    d = before
    while len(chosen) < days:
        d -= dt.timedelta(days=1)
        if d.weekday() < 5 and d not in holidays:
            chosen.append(d)
    return dense.filter(F.col("day").isin(chosen)).groupBy("stationID", "slot").agg(
        *[F.avg(c).alias(c) for c in FLOWS])


def profile_scaling(dense: DataFrame, last_day: dt.date, week_from: dt.date, week_to: dt.date,
                    holidays: Sequence[dt.date] = (), damping: float = PROFILE_DAMPING) -> DataFrame:
    """Hour level of the last day, spread over the slots like in an earlier week, slightly damped.

    One aggregation per (station, slot) feeds the hour levels, so the dense flow is read once and
    the hour means are windows of six rows.
    """
    day = F.col("day")
    week = day.between(F.lit(week_from), F.lit(week_to)) & is_business_day(day, holidays)
    last = day == F.lit(last_day)
    sums = dense.filter(week | last).groupBy("stationID", "slot").agg(*[
        F.avg(F.when(cond, F.col(c)).cast("double")).alias(f"_{kind}_{c}")
        for c in FLOWS for kind, cond in (("week", week), ("last", last))])
    hour = Window.partitionBy("stationID", hour_of(F.col("slot")))
    out = []
    for c in FLOWS:
        share = ratio(F.col(f"_week_{c}"), F.avg(f"_week_{c}").over(hour))
        out.append(F.coalesce(F.avg(f"_last_{c}").over(hour) * share * F.lit(damping), F.lit(0.0)).alias(c))
    return sums.select("stationID", "slot", *out)


def early_cap(df: DataFrame, until_hour: int = EARLY_HOURS_END, cap: int = EARLY_HOURS_CAP) -> DataFrame:
    """Small irregular counts before the first trains are cut to ``cap``."""
    early = hour_of(F.col("slot")) < until_hour
    return df.withColumns({c: F.when(early, F.least(F.col(c), F.lit(cap))).otherwise(F.col(c)) for c in FLOWS})


def normalise(df: DataFrame, columns: Sequence[str] = FLOWS, source: DataFrame | None = None) -> DataFrame:
    """Min-max scaled columns ``*_norm`` over the whole table (or over ``source``)."""
    source = df if source is None else source
    out = {}
    for c in columns:
        low, high = (source.agg(fn(c)).scalar() for fn in (F.min, F.max))
        out[f"{c}_norm"] = F.coalesce(ratio(F.col(c) - low, high - low), F.lit(0.0))
    return df.withColumns(out)


def triple_smoothing(dense: DataFrame, alpha: float = 0.3, steps: int = 1, column: str = "inNums") -> DataFrame:
    """Forecast of each (station, slot) series by triple exponential smoothing over its days.

    A series has one value per day; it is folded in day order inside one expression.
    """
    a = alpha
    series = dense.groupBy("stationID", "slot").agg(F.array_sort(F.collect_list(
        F.struct("day", F.col(column).cast("double").alias("x")))).alias("_s"))
    first = F.get("_s", F.lit(0))["x"]
    start = F.struct(first.alias("s1"), first.alias("s2"), first.alias("s3"))

    def step(state: Column, item: Column) -> Column:
        s1 = F.lit(a) * item["x"] + F.lit(1 - a) * state["s1"]
        s2 = F.lit(a) * s1 + F.lit(1 - a) * state["s2"]
        s3 = F.lit(a) * s2 + F.lit(1 - a) * state["s3"]
        return F.struct(s1.alias("s1"), s2.alias("s2"), s3.alias("s3"))

    def finish(s: Column) -> Column:
        level = 3 * s["s1"] - 3 * s["s2"] + s["s3"]
        slope = F.lit(a / (2 * (1 - a) ** 2)) * (
            F.lit(6 - 5 * a) * s["s1"] - F.lit(2 * (5 - 4 * a)) * s["s2"] + F.lit(4 - 3 * a) * s["s3"])
        bend = F.lit(a ** 2 / (2 * (1 - a) ** 2)) * (s["s1"] - 2 * s["s2"] + s["s3"])
        return level + slope * F.lit(steps) + bend * F.lit(steps ** 2)

    tail = F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1)))
    return series.select("stationID", "slot", F.aggregate(tail, start, step, finish).alias(f"{column}_smooth"))


def week_over_week(dense: DataFrame, days_back: int = 7) -> DataFrame:
    """Change against the same weekday one week earlier, where that day exists."""
    w = Window.partitionBy("stationID", "slot").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(
        -days_back, -days_back)
    out = {}
    for c in FLOWS:
        out[f"{c}_week"] = F.max(c).over(w)
        out[f"{c}_change"] = F.col(c) - F.max(c).over(w)
    return dense.withColumns(out).filter(F.col("inNums_week").isNotNull())


def covering(swipes: DataFrame, days: Sequence[dt.date]) -> DataFrame:
    """Swipes of the span of time that holds all ``days``; the bounds sit on the time itself and reach the scan."""
    return swipes.filter((F.col("time") >= midnight(min(days))) & (F.col("time") < midnight(max(days) + dt.timedelta(days=1))))


def recent_days(df: DataFrame, days: Sequence[dt.date]) -> DataFrame:
    """Training rows of a few chosen days."""
    return df.filter(F.col("day").isin(list(days)))
