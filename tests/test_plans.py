"""Whole forecasts: shape, bounds, leaks; and the streaming form of the slot flow."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gateflow.operators import flow
from gateflow.plans import total_flow
from gateflow.queries import QUERIES
from gateflow.queries.registry import FIRST_DAY, FORECAST_DAY
from gateflow.session import run_folder
from gateflow.sources.swipes import read_event_swipes, swipes_from_events
from gateflow.streaming import slot_stream
from tests.conftest import SF, rows


@pytest.mark.parametrize("name", ["gbt_forecast", "gbt_paytype", "gbt_anchor_windows", "gbt_wide_days"])
def test_forecast_covers_the_template(spark, name):
    got = QUERIES[name](spark, SF).cache()
    assert got.count() == 10 * 144
    assert got.filter("inNums < 0 OR outNums < 0 OR inNums IS NULL OR outNums IS NULL").count() == 0
    assert got.filter("stationID = 4 AND (inNums <> 0 OR outNums <> 0)").count() == 0


def test_boosted_forecast_beats_the_previous_day(spark):
    sf = SF.replace("0.001", "0.1")  # the smaller tables leave most slots empty
    truth = QUERIES["slot_flow"](spark, sf).select("stationID", "startTime", F.col("inNums").alias("x"))
    error = {}
    for name in ("naive_forecast", "gbt_forecast"):
        joined = QUERIES[name](spark, sf).filter("stationID <> 4").join(truth, ["stationID", "startTime"], "left")
        error[name] = joined.agg(F.avg(F.abs(F.col("inNums") - F.coalesce("x", F.lit(0))))).first()[0]
    assert error["gbt_forecast"] < error["naive_forecast"]


def test_rolling_errors(spark):
    got = QUERIES["gbt_rolling_origin"](spark, SF).collect()
    assert len(got) == 6 and all(r.mae >= 0 for r in got)


def test_features_do_not_leak(spark):
    """Changing the forecast day changes no feature of any row."""
    sw = read_event_swipes(spark, SF)
    changed = sw.withColumn("status", F.when(F.to_date("time") == F.lit(FORECAST_DAY), 1 - F.col("status"))
                            .otherwise(F.col("status")))
    a, b = (total_flow.feature_table(s, FIRST_DAY, FORECAST_DAY) for s in (sw, changed))
    assert rows(a.na.fill(-1)) == rows(b.na.fill(-1))


def test_own_day_is_not_a_feature(spark):
    """Changing one day changes no feature of that day, only its label."""
    day = dt.date(2024, 1, 20)
    sw = read_event_swipes(spark, SF)
    changed = sw.withColumn("status", F.when(F.to_date("time") == F.lit(day), 1 - F.col("status")).otherwise(F.col("status")))
    a, b = (total_flow.feature_table(s, FIRST_DAY, FORECAST_DAY).filter(F.col("day") == F.lit(day))
            .drop("inNums", "outNums") for s in (sw, changed))
    assert rows(a.na.fill(-1)) == rows(b.na.fill(-1))


def test_stream_equals_batch_on_closed_slots(spark):
    folder = run_folder(spark, "stream")
    events = slot_stream.event_stream(spark, SF)
    slot_stream.start(slot_stream.slot_flow_stream(swipes_from_events(events)), f"{folder}/rows",
                      f"{folder}/state").awaitTermination()
    streamed = spark.read.parquet(f"{folder}/rows")
    batch = flow.windowed_counts(read_event_swipes(spark, SF))
    assert streamed.exceptAll(batch.select(streamed.columns)).count() == 0
    assert 0 <= batch.count() - streamed.count() <= 20
