import datetime as dt
import random

from pyspark.sql import functions as F

from gateflow.functions import timefields as tf
from gateflow.operators import grid, history, trailing
from tests.conftest import rows

HOL = [dt.date(2024, 1, 1)]
ORIGIN = dt.date(2024, 1, 2)


def days(n, start=dt.date(2024, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def business(df):
    return tf.add_time_fields(grid.business_days(df, HOL).withColumn(
        "businessIndex", tf.business_index(F.col("day"), HOL, ORIGIN)))


def test_monday_lag_is_friday(make_flow):
    flow = make_flow([(1, d, 0, i, 0) for i, d in enumerate(days(10))])
    got = history.business_day_lags(business(flow), ["inNums"], [1])
    assert [r[0] for r in got.filter(F.col("day") == F.lit(dt.date(2024, 1, 8))).select("inNums_lag_1").collect()] == [4]


def test_dense_lag_equals_previous_day_join(make_flow):
    random.seed(1)
    flow = make_flow([(s, d, t, random.randint(0, 9), random.randint(0, 9))
                      for s in (1, 2) for d in days(6) for t in range(5)])
    dense = flow.withColumn("businessIndex", F.dayofmonth("day"))
    lagged = history.business_day_lags(dense, ["inNums"], [1]).select("stationID", "day", "slot", "inNums_lag_1")
    joined = history.previous_day(dense, ["inNums"], "businessIndex").select("stationID", "day", "slot", "inNums_p")
    assert rows(lagged.na.fill(-1)) == rows(joined.na.fill(-1))


def test_previous_day_needs_adjacent_day(make_flow):
    flow = make_flow([(1, dt.date(2024, 1, 1), 0, 5, 0), (1, dt.date(2024, 1, 3), 0, 7, 0)])
    got = history.previous_day(flow.withColumn("dayIndex", F.dayofmonth("day")), ["inNums"])
    assert [r.inNums_p for r in got.collect()] == [None, None]
    first = history.previous_day(flow.withColumn("dayIndex", F.dayofmonth("day")), ["inNums"], first_from_itself=True)
    assert sorted((r.dayIndex, r.inNums_p) for r in first.collect())[0] == (1, 5)


def test_neighbours_do_not_cross_days_or_stations(make_flow):
    flow = make_flow([(s, d, t, 1, 1) for s in (1, 2) for d in days(2) for t in range(144)])
    got = history.neighbour_slots(flow)
    assert got.filter("slot = 0 AND inNums_1 IS NOT NULL").count() == 0
    assert got.filter("slot = 143 AND `inNums_-1` IS NOT NULL").count() == 0
    assert got.filter("inNums_1 IS NULL").count() == 4


def test_last_days_skip_missing_days(make_flow):
    flow = make_flow([(1, d, 0, d.day, 0) for d in days(7) if d.day != 4])
    got = history.last_days_wide(flow, [dt.date(2024, 1, 7)]).first()
    assert (got.In1, got.In2, got.In3, got.gap3, got.In5) == (6, 5, 3, 4, 1)


def test_last_days_look_past_a_long_gap(make_flow):
    flow = make_flow([(1, dt.date(2024, 1, d), 0, d, 0) for d in (1, 2, 3, 4, 9)])
    got = history.last_days_wide(flow, [dt.date(2024, 1, 10)]).first()
    assert (got.In1, got.In2, got.In3, got.In4, got.In5, got.gap2) == (9, 4, 3, 2, 1, 6)
    assert history.last_days_wide(flow, [dt.date(2024, 1, 10)], lookback=5).first().In2 is None


def test_rolling_mean_crosses_midnight(make_flow):
    flow = make_flow([(1, d, t, d.day * 1000 + t, 0) for d in days(2) for t in range(144)])
    got = {(r.day.day, r.slot): r.inNums_roll2 for r in history.rolling_mean(flow, ["inNums"]).collect()}
    assert len(got) == 288
    assert got[(1, 0)] == 0 and got[(1, 1)] == 1000.5 and got[(2, 0)] == (1143 + 2000) / 2


def test_strict_peaks_only(make_flow):
    flow = make_flow([(1, dt.date(2024, 1, 1), i, v, 0) for i, v in enumerate([1, 3, 2, 2, 5, 4])])
    assert rows(history.peaks_valleys(flow), "slot", "kind") == [(1, "peak"), (4, "peak")]


def test_expanding_includes_own_day(make_flow):
    flow = tf.add_time_fields(make_flow([(1, d, 0, v, 0) for d, v in zip(days(3), (4, 2, 9))]))
    got = history.expanding_stats(flow).orderBy("day").collect()
    assert [(r.in_h_max, r.in_h_min, r.in_h_mean) for r in got] == [(4, 4, 4), (4, 2, 3), (9, 2, 5)]


def brute(data, anchor, n, column, key):
    return [r[column] for r in data if anchor - n <= r["idx"] < anchor and key(r)]


def test_trailing_against_brute_force(spark):
    random.seed(2)
    data = [{"stationID": s, "idx": i, "slot": t, "inNums": random.randint(0, 9), "outNums": 0}
            for s in (1, 2) for i in range(1, 9) for t in (0, 1, 7)]
    flow = spark.createDataFrame([(r["stationID"], r["idx"], r["slot"], r["inNums"], 0) for r in data],
                                 "stationID INT, businessIndex INT, slot INT, inNums BIGINT, outNums BIGINT")
    flow = flow.withColumns({"weekday": F.col("businessIndex") % 5, "hour": tf.hour_of(F.col("slot")),
                             "minute": tf.minute_of(F.col("slot"))})
    labels = flow.filter("businessIndex = 6").withColumn("anchor", F.lit(6))
    got = trailing.add_trailing_stats(labels, flow, [6], windows=(2, 5, 9), spec={"s": ["mean", "median", "max"]})
    for r in got.collect():
        values = sorted(brute(data, 6, 5, "inNums", lambda x: x["stationID"] == r.stationID))
        assert abs(r.inNums_mean_s_5 - sum(values) / len(values)) < 1e-12
        middle = (values[len(values) // 2] + values[(len(values) - 1) // 2]) / 2
        assert r.inNums_median_s_5 == middle and r.inNums_max_s_5 == max(values)
        assert r.inNums_mean_s_9 is None  # longer than the history


def test_single_row_deviation_is_zero(make_flow):
    flow = business(make_flow([(1, dt.date(2024, 1, 2), 0, 5, 5), (1, dt.date(2024, 1, 3), 0, 1, 1)]))
    labels = flow.filter("businessIndex = 2").withColumn("anchor", F.lit(2))
    got = trailing.add_trailing_stats(labels, flow, [2], windows=(1,), spec={"s": ["std", "var", "mean"]}).first()
    assert (got.inNums_std_s_1, got.inNums_var_s_1, got.inNums_mean_s_1) == (0, 0, 5)


def test_features_do_not_see_the_label_day(make_flow):
    base = [(1, d, t, d.day + t, 1) for d in days(12) for t in range(3)]
    changed = [(s, d, t, 999 if d == dt.date(2024, 1, 11) else i, o) for s, d, t, i, o in base]

    def features(data):
        flow = business(make_flow(data))
        labels = flow.filter("businessIndex = 8").withColumn("anchor", F.lit(8))
        out = trailing.add_trailing_stats(labels, flow, [8], windows=(3,), spec={"s": ["mean"], "s_w_h": ["max"]})
        return rows(out.drop("inNums", "outNums"))

    assert features(base) == features(changed)


def test_anchor_lists():
    assert trailing.anchors_before(21, 2) == [19, 17, 15, 13, 11, 9, 7, 5, 3]
    assert trailing.anchors_before(21, 5, cap=2) == [16, 11]


def test_slip_sets_have_all_parts(make_flow):
    flow = business(make_flow([(1, d, t, d.day, 1) for d in days(30) for t in (0, 9)]))
    got = trailing.slip_sets(flow, 3, 20, 21, cap=3)
    sizes = {r.part: r["count"] for r in got.groupBy("part").count().collect()}
    assert sizes == {"train": 18, "train_all": 18, "valid": 2, "test": 2}
