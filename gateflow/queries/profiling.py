"""Profiling, quality, selection and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gateflow.functions import numeric as num
from gateflow.functions import timefields as tf
from gateflow.operators import flow, history, profile, selection
from gateflow.queries.flow import dense_flow, stored_flow, swipes
from gateflow.queries.registry import DENSE, FIRST_DAY, FLOW, FORECAST_DAY, SWIPE, day_text, query, with_
from gateflow.session import materialise

# Swipes with holes: low device numbers are blanked so that missing values occur.
_HOLES = "h AS (SELECT *, CASE WHEN deviceID >= 10 THEN deviceID END AS device2 FROM swipe)"


def holed(spark, sf_dir):
    return swipes(spark, sf_dir).withColumn("device2", F.when(F.col("deviceID") >= 10, F.col("deviceID")))


_PROFILED = ["event_id", "stationID", "deviceID", "status", "payType", "value", "device2"]  # all numeric columns


@query("column_profile", with_(SWIPE, _HOLES) + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max",
       count(*) - count({c}) AS missing,
       CASE WHEN abs(sum({c} - trunc({c}))) >= 0.01 THEN 'float'
            WHEN min({c}) - CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END >= -128 AND max({c}) < 128 THEN 'tinyint'
            WHEN min({c}) - CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END >= -32768 AND max({c}) < 32768
              THEN 'smallint'
            WHEN min({c}) >= -2147483647 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END AS type
FROM h""" for c in _PROFILED))
def column_profile(spark, sf_dir):
    return profile.column_profile(holed(spark, sf_dir), _PROFILED)


@query("narrowed_columns", with_(SWIPE, _HOLES) + """
SELECT CAST(event_id AS INTEGER) AS event_id, time, lineID, userID, CAST(stationID AS TINYINT) AS stationID, CAST(deviceID AS TINYINT) AS deviceID,
       CAST(status AS TINYINT) AS status, CAST(payType AS TINYINT) AS payType, CAST(coalesce(device2, 9) AS TINYINT) AS device2,
       CAST(value AS FLOAT) AS value FROM h""")
def narrowed_columns(spark, sf_dir):
    """Every numeric column. event_id is a smallint or an integer by the number of rows; both are shown as integers."""
    narrowed = profile.narrow(holed(spark, sf_dir), _PROFILED)[0]
    return narrowed.withColumn("event_id", F.col("event_id").cast("int"))


# Every column; times as text, which both engines write alike.
_COLUMNS = ["event_id", "timeText", "lineID", "stationID", "deviceID", "status", "userID", "payType", "value", "device2"]
_SHOWN = ["valueText" if c == "value" else c for c in _COLUMNS]  # the text of a fraction differs between engines: six decimals
_TIMED = "h AS (SELECT *, CAST(CAST(value AS DECIMAL(18, 6)) AS VARCHAR) AS valueText, strftime(time, '%Y-%m-%d %H:%M:%S') AS timeText, CASE WHEN deviceID >= 10 THEN deviceID END AS device2 FROM swipe)"


def timed(spark, sf_dir):
    return holed(spark, sf_dir).withColumns({"timeText": F.date_format("time", "yyyy-MM-dd HH:mm:ss"),
                                             "valueText": F.col("value").cast("decimal(18,6)").cast("string")}).drop("time")


def _counts_sql(columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM h GROUP BY 2""" for c in columns)


@query("value_frequencies", with_(SWIPE, _TIMED, f"c AS ({_counts_sql(_SHOWN)})") + """
SELECT "column", coalesce(value, 'none') AS value, n, n / (SELECT count(*) FROM h) AS share FROM c""")
def value_frequencies(spark, sf_dir):
    return profile.value_frequencies(timed(spark, sf_dir), _SHOWN).na.fill("none", ["value"])


@query("column_stats", with_(SWIPE, _TIMED, f"c AS ({_counts_sql(_COLUMNS)})") + """
SELECT "column", max(n) / (SELECT count(*) FROM h) AS topShare, count(value) AS nunique FROM c GROUP BY 1""")
def column_stats(spark, sf_dir):
    return profile.column_stats(timed(spark, sf_dir), _COLUMNS)


_NUMERIC = ["event_id", "stationID", "deviceID", "status", "payType", "value", "device2"]


def _summary_sql(c: str) -> str:
    number = c in _NUMERIC
    freq = f"(SELECT max(n) FROM (SELECT count(*) n FROM h WHERE {c} IS NOT NULL GROUP BY {c}))"
    top = (f"CASE WHEN {freq} > 1 THEN (SELECT CAST({c} AS VARCHAR) FROM h WHERE {c} IS NOT NULL GROUP BY {c} "
           f"ORDER BY count(*) DESC, CAST({c} AS VARCHAR) DESC LIMIT 1) END")
    numbers = [f"round(avg({c}), 6)", f"round(stddev_samp({c}), 6)", f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)",
               *[f"round(quantile_cont({c}, {q}), 6)" for q in (0.25, 0.5, 0.75)]] if number else ["CAST(NULL AS DOUBLE)"] * 7
    names = ["mean", "std", '"min"', '"max"', "q25", "q50", "q75"]
    return (f"SELECT '{c}' AS \"column\", count({c}) AS count, count(DISTINCT {c}) AS \"unique\", coalesce({top}, 'none') AS top, "
            f"{freq} AS freq, " + ", ".join(f"{e} AS {n}" for e, n in zip(numbers, names)) + " FROM h")


@query("summary_stats", with_(SWIPE, _TIMED) + " UNION ALL ".join(_summary_sql(c) for c in _COLUMNS))
def summary_stats(spark, sf_dir):
    out = profile.summary(timed(spark, sf_dir), _COLUMNS)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")}).na.fill("none", ["top"])


@query("null_profile", with_(SWIPE, _HOLES) + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls FROM h"""
    for c in ["event_id", "time", "lineID", "stationID", "deviceID", "status", "userID", "payType", "value", "device2"]))
def null_profile(spark, sf_dir):
    return profile.null_profile(holed(spark, sf_dir))


@query("outlier_checks", with_(SWIPE) + """
SELECT CAST(max(CASE WHEN stationID = 4 THEN 1 ELSE 0 END) AS INTEGER) AS closedSeen,
       CAST(max(CASE WHEN day < DATE '2024-01-01' OR day > DATE '2024-01-30' THEN 1 ELSE 0 END) AS INTEGER)
         AS timeOutside,
       CAST(min(CASE WHEN status IN (0, 1) THEN 1 ELSE 0 END) AS INTEGER) AS statusKnown
FROM swipe""")
def outlier_checks(spark, sf_dir):
    return profile.outlier_checks(swipes(spark, sf_dir), 4, FIRST_DAY, FORECAST_DAY)


@query("distinct_days_stations", with_(SWIPE) + """
SELECT DISTINCT strftime(swipe.day, '%Y-%m-%d') AS day, stationID, lineID,
       CASE lineID WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 END AS lineCode FROM swipe""")
def distinct_days_stations(spark, sf_dir):
    rows = flow.with_slot(swipes(spark, sf_dir)).select("day", "stationID", "lineID").distinct()
    return day_text(rows.withColumn("lineCode", num.line_code(F.col("lineID"))))


_QUASI = ["stationID", "slot", "inNums", "outNums", "busy", "version"]
_QUASI_SQL = ("q AS (SELECT stationID, slot, inNums, outNums, CASE WHEN inNums > 30 THEN 'busy' END AS busy, "
              "1 AS version FROM dense)")


@query("quasi_constant", with_(DENSE, _QUASI_SQL) + 'SELECT * FROM (' + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", max(n) / (SELECT count(*) FROM q) AS topShare
    FROM (SELECT {c}, count(*) n FROM q GROUP BY 1)""" for c in _QUASI) + ") WHERE topShare > 0.90")
def quasi_constant(spark, sf_dir):
    rows = materialise(dense_flow(spark, sf_dir).select(
        "stationID", "slot", "inNums", "outNums", F.when(F.col("inNums") > 30, "busy").alias("busy"),
        F.lit(1).alias("version")), "quasi")  # read twice below
    return selection.dominant_values(rows)


_CORR = ["inNums", "outNums", "inNums_p", "outNums_p", "slot", "weekday"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]


@query("feature_correlation", with_(DENSE) + """,
x AS (SELECT a.inNums, a.outNums, b.inNums AS inNums_p, b.outNums AS outNums_p, a.slot, a.weekday
      FROM dense a JOIN dense b ON a.stationID = b.stationID AND a.slot = b.slot AND a.day = b.day + INTERVAL 1 DAY)
""".lstrip() + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM x" for a, b in _PAIRS))
def feature_correlation(spark, sf_dir):
    rows = dense_flow(spark, sf_dir).withColumns({
        "dayIndex": F.datediff("day", F.lit(FIRST_DAY)) + 1, "weekday": tf.weekday(F.col("day"))})
    rows = history.previous_day(rows).filter(F.col("dayIndex") > 1)
    return selection.correlation_matrix(rows, _CORR).withColumn("correlation", F.round("correlation", 6))


@query("dataset_equality", with_(FLOW) + """,
a AS (SELECT stationID, day, slot, inNums, outNums FROM flow WHERE day < DATE '2024-01-20'),
b AS (SELECT stationID, day, slot, CASE WHEN stationID = 4 THEN 0 ELSE inNums END AS inNums, outNums FROM flow
      WHERE day < DATE '2024-01-21'),
u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 AS s FROM b)
SELECT stationID, strftime(u.day, '%Y-%m-%d') AS day, slot, inNums, outNums, CAST(sum(s) AS BIGINT) AS surplus
FROM u GROUP BY stationID, u.day, slot, inNums, outNums HAVING sum(s) <> 0""".lstrip())
def dataset_equality(spark, sf_dir):
    """Two versions of the flow: one lacks a day, the other has a closed station."""
    import datetime as dt
    rows = stored_flow(spark, sf_dir)
    a = rows.filter(F.col("day") < F.lit(dt.date(2024, 1, 20)))
    b = rows.filter(F.col("day") < F.lit(dt.date(2024, 1, 21))).withColumn(
        "inNums", F.when(F.col("stationID") == 4, F.lit(0)).otherwise(F.col("inNums")))
    return day_text(profile.differences(a, b))


@query("preview", with_(SWIPE) + """
SELECT event_id, stationID, deviceID, status, payType, lineID, userID FROM swipe ORDER BY event_id LIMIT 5""")
def preview(spark, sf_dir):
    """The first rows in the order of their ids: a top-k, no sort of the table."""
    rows = swipes(spark, sf_dir).select("event_id", "stationID", "deviceID", "status", "payType", "lineID", "userID")
    return profile.preview(rows.orderBy("event_id"))


@query("union_unlike", with_(DENSE) + """
SELECT stationID, strftime(flow.day, '%Y-%m-%d') AS day, slot, CAST(inNums AS DOUBLE) AS inNums,
       CAST(outNums AS DOUBLE) AS outNums FROM flow WHERE day < DATE '2024-01-30'
UNION ALL
SELECT stationID, '2024-01-30', slot, NULL, NULL FROM cells WHERE day = DATE '2024-01-30'""")
def union_unlike(spark, sf_dir):
    """Training rows and forecast rows; the latter have no flow columns."""
    from gateflow.operators import grid
    rows = stored_flow(spark, sf_dir)
    known = rows.filter(F.col("day") < F.lit(FORECAST_DAY))
    ahead = grid.grid(rows, FORECAST_DAY, FORECAST_DAY)
    both = known.unionByName(ahead, allowMissingColumns=True)
    return day_text(both.withColumns({c: F.col(c).cast("double") for c in ("inNums", "outNums")}))
