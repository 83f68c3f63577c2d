import datetime as dt

from pyspark.sql import functions as F

from gateflow.operators import forecast, grid
from gateflow.plans.naive import naive_forecast
from tests.conftest import rows

DAY = dt.date(2024, 1, 30)


def test_naive_forecast_moves_counts(make_swipes):
    sw = make_swipes([("2024-01-29 08:05:00", 1, 1, 1, "u", 0), ("2024-01-28 08:05:00", 1, 1, 1, "u", 0)])
    got = naive_forecast(sw, dt.date(2024, 1, 29), DAY)
    assert got.count() == 144
    assert rows(got.filter("inNums > 0"), "startTime", "inNums") == [(dt.datetime(2024, 1, 30, 8, 0), 1)]


def test_blend_is_by_key(make_flow):
    a = make_flow([(1, DAY, 0, 2, 0), (1, DAY, 1, 4, 0)])
    b = make_flow([(1, DAY, 1, 8, 0), (1, DAY, 0, 0, 0)])
    assert rows(forecast.blend([a, b]), "slot", "inNums") == [(0, 1.0), (1, 6.0)]
    assert rows(forecast.blend([a, b], [3, 1]), "slot", "inNums") == [(0, 1.5), (1, 5.0)]


def test_submission(make_flow, spark):
    stations = make_flow([(1, DAY, 0, 0, 0), (54, DAY, 0, 0, 0)])
    raw = make_flow([(1, DAY, 0, 50, 50), (1, DAY, 60, 9000, -3), (54, DAY, 60, 7, 7)])
    night = spark.createDataFrame([(1, 0, 3.0, 4.0)], "stationID INT, slot INT, night_in DOUBLE, night_out DOUBLE")
    got = forecast.submission(grid.template(stations, DAY), raw, night, closed=[54])
    assert got.count() == 288
    by = {(r.stationID, r.slot): (r.inNums, r.outNums) for r in got.collect()}
    assert by[(1, 0)] == (3, 4) and by[(1, 60)] == (4000, 0) and by[(54, 60)] == (0, 0) and by[(1, 142)] == (0, 0)


def test_errors(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0)], "t DOUBLE, p DOUBLE")
    got = forecast.errors(df, {"x": ("t", "p")}).first()
    assert (got.mae_x, got.relative_x) == (1.0, 0.5)


def test_profile_scaling_by_hand(make_flow):
    week, last = dt.date(2024, 1, 24), dt.date(2024, 1, 29)
    cells = [(1, week, 0, 6, 0), (1, last, 0, 12, 0)] + [
        (1, d, t, 0, 0) for d in (week, last) for t in range(1, 6)]
    got = forecast.profile_scaling(make_flow(cells), last, dt.date(2024, 1, 22), dt.date(2024, 1, 26))
    by = {r.slot: r.inNums for r in got.collect()}
    assert abs(by[0] - 2 * 6 / 1 * 0.95) < 1e-9 and by[1] == 0


def test_early_cap_and_normalise(make_flow):
    flow = make_flow([(1, DAY, 35, 9, 1), (1, DAY, 36, 9, 0)])
    assert rows(forecast.early_cap(flow), "slot", "inNums") == [(35, 2), (36, 9)]
    assert rows(forecast.normalise(flow, ["outNums"]), "slot", "outNums_norm") == [(35, 1.0), (36, 0.0)]


def test_smoothing_of_a_constant_series(make_flow):
    flow = make_flow([(1, dt.date(2024, 1, d), 0, 5, 0) for d in range(1, 9)])
    assert abs(forecast.triple_smoothing(flow).first().inNums_smooth - 5) < 1e-9
    assert abs(forecast.triple_smoothing(flow.limit(1)).first().inNums_smooth - 5) < 1e-9


def test_smoothing_follows_a_trend(make_flow):
    flow = make_flow([(1, dt.date(2024, 1, 1) + dt.timedelta(days=d), 0, d, 0) for d in range(60)])
    assert abs(forecast.triple_smoothing(flow, 0.5).first().inNums_smooth - 60) < 1e-3


def test_week_over_week(make_flow):
    flow = make_flow([(1, dt.date(2024, 1, d), 0, d, 0) for d in (1, 8, 9)])
    assert rows(forecast.week_over_week(flow), "day", "inNums_change") == [(dt.date(2024, 1, 8), 7)]


def test_mean_of_last_business_days(make_flow):
    flow = make_flow([(1, dt.date(2024, 1, d), 0, d, 0) for d in range(20, 31)])
    assert forecast.mean_of_days(flow, DAY, 2).first().inNums == (29 + 26) / 2


def test_mean_over_folds(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "label STRING, mae DOUBLE")
    assert rows(forecast.mean_over_folds(df)) == [("a", 2.0)]
