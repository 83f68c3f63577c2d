"""Stored partials that merge: expanding state, trailing windows, bitmaps, value counts."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gateflow.functions import timefields as tf
from gateflow.operators import expanding_state, flow, history, trailing
from gateflow.session import run_folder
from gateflow.sources import swipes as src
from tests.conftest import rows


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(4)
    data = [(s, dt.date(2024, 1, d), k, rng.randrange(9), rng.randrange(5)) for s in (1, 2) for d in (1, 2, 3, 5, 8, 9) for k in range(0, 144, 7)
            if rng.random() < 0.8]
    return tf.add_time_fields(spark.createDataFrame(data, "stationID INT, day DATE, slot INT, inNums BIGINT, outNums BIGINT")).cache()


def test_state_equals_windows_and_reads_one_day(spark, days):
    folder, flows = run_folder(spark, "state"), run_folder(spark, "flows")
    days.write.partitionBy("day").parquet(flows)
    dates, previous = [r[0] for r in days.select("day").distinct().orderBy("day").collect()], None
    for day in dates:
        own = spark.read.parquet(f"{flows}/day={day}").withColumn("day", F.lit(day))
        files = expanding_state.step(spark, folder, previous, day, own).inputFiles()
        assert {f.split("day=")[1].split("/")[0] for f in files} <= {str(day), str(previous)}
        expanding_state.advance(spark, folder, previous, day, own)
        previous = day
    got = expanding_state.attach(days, spark.read.parquet(folder), extra=["day"])
    want = history.expanding_stats(days)
    assert rows(got, *want.columns) == rows(want)
    # a late file: steps from its day on give the state of all rows
    late = days.limit(5).withColumn("inNums", F.lit(100).cast("long")).withColumn("day", F.lit(dates[3]))
    both = days.unionByName(late)
    for before, day in zip(dates[2:], dates[3:]):
        expanding_state.advance(spark, folder, before, day, both.filter(F.col("day") == F.lit(day)))
    want = expanding_state.day_partials(both)
    last = spark.read.schema(want.schema).parquet(expanding_state.version(folder, dates[-1]))
    assert rows(last.na.fill(-1)) == rows(want.na.fill(-1))


def test_versions_hold_groups_not_days(spark, days):
    one = expanding_state.day_partials(days.filter("day = '2024-01-01'"))
    assert expanding_state.merge(one, one).count() == one.count()


def test_trailing_windows_do_not_repeat_the_history(spark):
    flow_ = spark.range(2000).select((F.col("id") % 2).cast("int").alias("stationID"), (F.col("id") % 7).cast("int").alias("weekday"),
                                     F.lit(0).alias("hour"), F.lit(0).alias("minute"), (F.col("id") % 20 + 1).cast("int").alias("businessIndex"),
                                     (F.col("id") % 11).alias("inNums"), (F.col("id") % 13).alias("outNums"))
    def expanded(anchors):
        plan = trailing.trailing_stats(flow_, anchors, ["stationID"], "s", (3,), ["median"])._jdf.queryExecution().optimizedPlan().toString()
        return [line for line in plan.split("\n") if "Generate" in line and "businessIndex" in line and "inNums" in line.split("Generate")[1][:40]]
    assert not expanded(range(2, 5)) and not expanded(range(2, 20))
    got = {(r.anchor, r.stationID): r for r in trailing.trailing_stats(flow_, [5, 21], ["stationID"], "s", (1, 3), trailing.STATS).collect()}
    data = [tuple(r) for r in flow_.select("stationID", "businessIndex", "inNums").collect()]
    for anchor in (5, 21):
        for n in (1, 3):
            values = [v for s, i, v in data if s == 1 and anchor - n <= i < anchor]
            r = got[anchor, 1]
            if not values:
                assert r[f"inNums_mean_s_{n}"] == 0
                continue
            assert r[f"inNums_median_s_{n}"] == statistics.median(values) and r[f"inNums_mean_s_{n}"] == pytest.approx(statistics.mean(values))
            assert r[f"inNums_var_s_{n}"] == pytest.approx(statistics.variance(values)) and r[f"inNums_std_s_{n}"] == pytest.approx(statistics.stdev(values))
            assert (r[f"inNums_min_s_{n}"], r[f"inNums_max_s_{n}"]) == (min(values), max(values))


def test_trailing_fractions_and_missing_values(spark):
    data = [(1, 0, 0, 0, i, v, None) for i, v in ((1, 0.5), (2, None), (3, 1.5), (3, 4.25))]
    table = spark.createDataFrame(data, "stationID INT, weekday INT, hour INT, minute INT, businessIndex INT, inNums DOUBLE, outNums DOUBLE")
    r = trailing.trailing_stats(table, [4], ["stationID"], "s", (3,), trailing.STATS).first()
    assert r.inNums_median_s_3 == 1.5 and r.inNums_mean_s_3 == pytest.approx(6.25 / 3) and r.inNums_var_s_3 == pytest.approx(3.770833333)
    assert r.outNums_median_s_3 == r.outNums_mean_s_3 == r.outNums_max_s_3 == 0


def test_bitmaps_count_like_distinct(spark):
    values = [0, 1, 1, 32_767, 32_768, 32_769, 10**9, None, -1, -32_768, 5]
    data = [(s, h, v) for s in (1, 2) for h in (0, 1) for k, v in enumerate(values) if (k + s + h) % 3]
    table = spark.createDataFrame(data + [(3, 0, None)], "stationID INT, hour INT, deviceID INT")
    grains = {"s": ["stationID"], "sh": ["stationID", "hour"]}
    got = flow.distinct_by_bitmaps(flow.device_bitmaps(table, "deviceID", ["stationID", "hour"]), grains)
    want = flow.distinct_counts(table, "deviceID", grains)
    assert rows(got.select("grain", "stationID", F.coalesce("hour", F.lit(-1)), "n")) == rows(want.select("grain", "stationID", F.coalesce("hour", F.lit(-1)), "n"))


def test_top_values_from_finer_counts(spark):
    data = [(s, h, d) for s in (1, 2) for h in (0, 1) for d in ([4, 4, 7] if h else [4, 7, 7, None])]
    table = spark.createDataFrame(data, "stationID INT, hour INT, deviceID INT")
    counts = flow.value_counts_by(table, ["deviceID"], ["stationID", "hour"])
    assert rows(flow.top_of_counts(counts, ["deviceID"], ["stationID"])) == rows(flow.top_values(table, ["deviceID"], ["stationID"])) == [(1, 7, 4), (2, 7, 4)]


def test_files_per_day_follow_row_counts(spark, make_swipes):
    data = [(f"2024-01-0{d} 10:{k % 60:02d}:00", 1, 1, 1, f"u{k}", 0) for d, n in ((1, 40), (2, 3)) for k in range(n)]
    folder = run_folder(spark, "swipes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the shares are far below a partition's size here
    try:
        src.write_swipe_files(make_swipes(data), folder, rows_per_task=10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_day = {}
    for f in src.read_swipe_files(spark, folder).inputFiles():
        day = f.split("record=")[1][:10]
        per_day[day] = per_day.get(day, 0) + 1
    assert 1 < per_day["2024-01-01"] <= 4 and per_day["2024-01-02"] == 1
    assert src.read_swipe_files(spark, folder).count() == 43
