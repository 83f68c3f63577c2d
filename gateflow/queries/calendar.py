"""Calendar queries: business days, their index and the way back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gateflow.functions import timefields as tf
from gateflow.operators import flow, grid
from gateflow.queries.flow import swipes
from gateflow.queries.registry import (BUSINESS, CLOSED, DENSE, FIRST_DAY, FORECAST_DAY, HOLIDAYS, ORIGIN, SWIPE,
                                       day_text, query, with_)


@query("business_calendar", with_(DENSE, BUSINESS) + """
SELECT strftime(d.day, '%Y-%m-%d') AS day, d.weekday, CASE WHEN d.weekday >= 5 THEN 1 ELSE 0 END AS weekend,
       CASE WHEN d.day = DATE '2024-01-01' THEN 1 ELSE 0 END AS holiday, coalesce(b.idx, -1) AS businessIndex,
       n.rows
FROM days d LEFT JOIN business b USING (day)
JOIN (SELECT day, count(*) AS rows FROM swipe GROUP BY 1) n USING (day)""")
def business_calendar(spark, sf_dir):
    """Calendar of the days present in the data, with their row counts."""
    counts = flow.with_slot(swipes(spark, sf_dir)).groupBy("day").agg(F.count(F.lit(1)).alias("rows"))
    cal = grid.calendar(spark, FIRST_DAY, FORECAST_DAY, HOLIDAYS)
    return day_text(cal.na.fill(-1, ["businessIndex"]).join(counts, "day"))


@query("business_flow", with_(DENSE, BUSINESS) + """
SELECT stationID, strftime(f.day, '%Y-%m-%d') AS day, idx AS businessIndex, slot, inNums, outNums,
       CAST(idx + 1 AS INTEGER) AS referDay
FROM flow f JOIN business USING (day)""")
def business_flow(spark, sf_dir):
    """Working days only, the index computed without a join."""
    rows = grid.business_days(flow.slot_flow(swipes(spark, sf_dir)), HOLIDAYS)
    return day_text(rows.select("stationID", "day", tf.business_index(F.col("day"), HOLIDAYS, ORIGIN)
                                .alias("businessIndex"), "slot", "inNums", "outNums")
                    .withColumn("referDay", F.col("businessIndex") + 1))


@query("recovered_days", with_(DENSE, BUSINESS) + """
SELECT idx AS businessIndex, strftime(f.day, '%Y-%m-%d') AS day, CAST(sum(inNums) AS BIGINT) AS inNums,
       CAST(sum(outNums) AS BIGINT) AS outNums
FROM flow f JOIN business USING (day) WHERE idx > 1 GROUP BY idx, f.day""")
def recovered_days(spark, sf_dir):
    """Totals per business index without the first day, turned back into real dates."""
    rows = grid.business_days(flow.slot_flow(swipes(spark, sf_dir)), HOLIDAYS).withColumn(
        "businessIndex", tf.business_index(F.col("day"), HOLIDAYS, ORIGIN)).filter("businessIndex > 1")
    totals = rows.groupBy("businessIndex").agg(F.sum("inNums").alias("inNums"), F.sum("outNums").alias("outNums"))
    return day_text(grid.recover_day(totals, grid.calendar(spark, FIRST_DAY, FORECAST_DAY, HOLIDAYS)))


@query("forecast_template", with_(SWIPE) + """
SELECT stationID, t AS startTime, t + INTERVAL 10 MINUTE AS endTime, CAST(p AS INTEGER) AS payType
FROM (SELECT DISTINCT stationID FROM swipe WHERE stationID <> 4) s,
     generate_series(TIMESTAMP '2024-01-30 00:00:00', TIMESTAMP '2024-01-30 23:50:00', INTERVAL 10 MINUTE) g(t),
     generate_series(0, 3) q(p)""")
def forecast_template(spark, sf_dir):
    stations = swipes(spark, sf_dir).filter(~F.col("stationID").isin(CLOSED))
    return grid.per_pay_type(grid.template(stations, FORECAST_DAY)).drop("day", "slot")
