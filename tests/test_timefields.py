import datetime as dt

from pyspark.sql import functions as F

from gateflow.functions import numeric as num
from gateflow.functions import timefields as tf
from gateflow.operators import grid
from tests.conftest import rows


def one(spark, column, text):
    return spark.sql(f"SELECT {text} AS x").select(column(F.col("x"))).first()[0]


def test_slot_boundaries(spark):
    df = spark.createDataFrame([("2024-01-01 00:09:59",), ("2024-01-01 00:10:00",), ("2024-01-01 23:59:59",)], "t STRING")
    t = tf.parse_time(F.col("t"))
    got = df.select(tf.slot_in_day(t), tf.floor_time(t)).collect()
    assert [r[0] for r in got] == [0, 1, 143]
    assert [r[1] for r in got] == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 10), dt.datetime(2024, 1, 1, 23, 50)]


def test_phase_offset_reaches_seventh_clip(spark):
    assert one(spark, lambda c: tf.slot_in_hour(c, offset=8), "timestamp_ntz'2024-01-01 10:55:00'") == 6


def test_weekday_conventions(spark):
    monday = "date'2019-01-28'"
    assert one(spark, tf.weekday, monday) == 0
    assert one(spark, lambda c: tf.weekday(c, first=1), monday) == 1
    assert one(spark, tf.weekend_flag, "date'2019-01-27'") == 1


def test_service_bands(spark):
    df = spark.createDataFrame([(h,) for h in (7, 8, 22, 18, 23)], "h INT")
    assert [r[0] for r in df.select(tf.service_band(F.col("h"), "X")).collect()] == [3, 5, 1, 4, 1]
    assert [r[0] for r in df.select(tf.service_band(F.col("h"), "Y")).collect()] == [5, 5, 3, 3, 1]


def test_business_index_matches_ranked_calendar(spark):
    holidays = [dt.date(2024, 1, 1), dt.date(2024, 2, 12), dt.date(2024, 2, 10)]
    cal = grid.calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31), holidays)
    got = cal.withColumn("i", tf.business_index(F.col("day"), holidays, dt.date(2024, 1, 2)))
    assert got.filter("NOT (i <=> businessIndex)").count() == 0
    assert got.agg(F.max("i")).first()[0] == 260
    back = grid.recover_day(spark.createDataFrame([(1,), (5,)], "businessIndex INT"), cal)
    assert rows(back, "businessIndex", "day") == [(1, dt.date(2024, 1, 2)), (5, dt.date(2024, 1, 8))]


def test_rounding_and_bounds(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-1.7,), (9.0,)], "x DOUBLE")
    x = F.col("x")
    assert [r[0] for r in df.select(num.half_even(x)).collect()] == [0, 2, 2, 2, 9]
    assert [r[0] for r in df.select(num.truncate(x)).collect()][3] == -1
    assert [r[0] for r in df.select(num.clip(x, 0.0, 2.0)).collect()] == [0.5, 1.5, 2, 0, 2]


def test_log_and_ratio(spark):
    df = spark.createDataFrame([(0, 3, 0), (1, 3, 2), (8, 0, 0)], "x INT, a INT, b INT")
    assert [r[0] for r in df.select(num.log_feature(F.col("x"))).collect()] == [0, 1, 4]
    assert [r[0] for r in df.select(num.ratio(F.col("a"), F.col("b"))).collect()] == [None, 1.5, None]


def test_equal_width_codes(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 2, 4, 6, 8, 10)], "x DOUBLE")
    code = num.equal_width_code(F.col("x"), F.lit(0.0), F.lit(10.0))
    assert [r[0] for r in df.select(code).collect()] == [0, 0, 1, 2, 3, 4]


def test_comfort_index(spark):
    got = spark.range(1).select(num.comfort_index(F.lit(20.0))).first()[0]
    expected = (1.818 * 20 + 18.18) * (0.88 + 0.002 * 0.6) + (20 - 32) / (45 - 20) - 3.2 * 2 + 18.2
    assert abs(got - expected) < 1e-9
