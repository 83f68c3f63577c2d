"""Forecast baselines, post-processing, blends and error metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gateflow.functions import numeric as num
from gateflow.functions import timefields as tf
from gateflow.operators import flow, forecast, grid, network, stats
from gateflow.queries.flow import dense_flow, stored_flow, swipes
from gateflow.queries.registry import CLOSED, DENSE, FORECAST_DAY, HOLIDAYS, PREVIOUS_DAY, SWIPE, day_text, query, with_
from gateflow.session import materialise

# Two simple forecasts of the forecast day: the previous business day, the mean of the last five.
TWO = DENSE + """,
two AS MATERIALIZED (
  SELECT stationID, slot, CAST(sum(inNums) FILTER (day = DATE '2024-01-29') AS DOUBLE) AS i1,
         CAST(sum(outNums) FILTER (day = DATE '2024-01-29') AS DOUBLE) AS o1, avg(inNums) AS i2, avg(outNums) AS o2
  FROM dense WHERE day IN (DATE '2024-01-23', DATE '2024-01-24', DATE '2024-01-25', DATE '2024-01-26', DATE '2024-01-29')
  GROUP BY 1, 2),
f1 AS (SELECT stationID, slot, i1 AS inNums, o1 AS outNums FROM two),
f2 AS (SELECT stationID, slot, i2 AS inNums, o2 AS outNums FROM two)"""


def two_forecasts(dense):
    f1 = dense.filter(F.col("day") == F.lit(PREVIOUS_DAY)).select("stationID", "slot", "inNums", "outNums")
    return f1, forecast.mean_of_days(dense, FORECAST_DAY, 5, HOLIDAYS)


@query("blend", with_(TWO) + """
SELECT stationID, slot, round((i1 + i2) / 2, 9) AS inNums, round((o1 + o2) / 2, 9) AS outNums FROM two""")
def blend(spark, sf_dir):
    dense = materialise(dense_flow(spark, sf_dir), "dense")
    out = forecast.blend(two_forecasts(dense), keys=["stationID", "slot"])
    return out.withColumns({c: F.round(c, 9) for c in ("inNums", "outNums")})


_WEEK = "day BETWEEN DATE '2024-01-22' AND DATE '2024-01-26'"
PROFILE = """prof AS (
  SELECT w.stationID, w.slot, coalesce(h.li * w.wi / nullif(h.wi, 0) * 0.95, 0) AS inNums,
         coalesce(h.lo * w.wo / nullif(h.wo, 0) * 0.95, 0) AS outNums
  FROM (SELECT stationID, slot, hour, avg(inNums) wi, avg(outNums) wo FROM dense WHERE """ + _WEEK + """
        GROUP BY 1, 2, 3) w
  JOIN (SELECT stationID, hour, avg(inNums) FILTER (""" + _WEEK + """) wi, avg(outNums) FILTER (""" + _WEEK + """) wo,
               avg(inNums) FILTER (day = DATE '2024-01-29') li, avg(outNums) FILTER (day = DATE '2024-01-29') lo
        FROM dense GROUP BY 1, 2) h USING (stationID, hour))"""


def profile_forecast(dense):
    return forecast.profile_scaling(dense, PREVIOUS_DAY, dt.date(2024, 1, 22), dt.date(2024, 1, 26), HOLIDAYS)


@query("profile_scaling", with_(DENSE, PROFILE) + """
SELECT stationID, slot, round(inNums, 9) AS inNums, round(outNums, 9) AS outNums FROM prof""")
def profile_scaling(spark, sf_dir):
    out = profile_forecast(dense_flow(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("inNums", "outNums")})


@query("weighted_blend", with_(TWO, PROFILE) + """
SELECT stationID, slot, round(0.5::DOUBLE * f1.inNums + 0.3::DOUBLE * f2.inNums + 0.2::DOUBLE * p.inNums, 9) AS inNums,
       round(0.5::DOUBLE * f1.outNums + 0.3::DOUBLE * f2.outNums + 0.2::DOUBLE * p.outNums, 9) AS outNums
FROM f1 JOIN f2 USING (stationID, slot) JOIN prof p USING (stationID, slot)""")
def weighted_blend(spark, sf_dir):
    dense = materialise(dense_flow(spark, sf_dir), "dense")
    out = forecast.blend([*two_forecasts(dense), profile_forecast(dense)], [0.5, 0.3, 0.2], keys=["stationID", "slot"])
    return out.withColumns({c: F.round(c, 9) for c in ("inNums", "outNums")})


@query("postprocess", with_(TWO) + """,
night AS (SELECT stationID, slot, avg(inNums) FILTER (inNums <> 0) AS i, avg(outNums) FILTER (outNums <> 0) AS o
          FROM flow WHERE day < DATE '2024-01-30' GROUP BY 1, 2),
sub AS (
  SELECT f2.stationID, slot,
         CASE WHEN slot * 10 >= 1420 OR slot * 10 <= 320 THEN coalesce(i, 0) ELSE f2.inNums END AS a,
         CASE WHEN slot * 10 <= 350 THEN coalesce(o, 0) ELSE f2.outNums END AS b
  FROM f2 LEFT JOIN night USING (stationID, slot))
SELECT stationID, TIMESTAMP '2024-01-30' + to_minutes(CAST(slot * 10 AS BIGINT)) AS startTime,
       TIMESTAMP '2024-01-30' + to_minutes(CAST(slot * 10 + 10 AS BIGINT)) AS endTime,
       CASE WHEN stationID = 4 THEN 0 ELSE least(a, 1.25) END AS inNums,
       CASE WHEN stationID = 4 THEN 0 ELSE least(b, 1.25) END AS outNums,
       round_even(CASE WHEN stationID = 4 THEN 0 ELSE least(a, 1.25) END, 0) AS inRounded,
       CAST(trunc(CASE WHEN stationID = 4 THEN 0 ELSE least(b, 1.25) END) AS INTEGER) AS outTruncated
FROM sub""".lstrip())
def postprocess(spark, sf_dir):
    """Night hours from history, closed station zero, bounds that fit the small counts, two roundings."""
    rows = stored_flow(spark, sf_dir)
    dense = grid.densify(rows, grid.grid(rows, dt.date(2024, 1, 23), PREVIOUS_DAY))
    night = stats.night_profile(rows.filter(F.col("day") < F.lit(FORECAST_DAY))).select(
        "stationID", "slot", F.col("mean_in").alias("night_in"), F.col("mean_out").alias("night_out"))
    mean = forecast.mean_of_days(dense, FORECAST_DAY, 5, HOLIDAYS).withColumn("day", F.lit(FORECAST_DAY))
    out = forecast.submission(grid.template(rows, FORECAST_DAY), mean, night, CLOSED, 1.25)
    return out.select("stationID", "startTime", "endTime", "inNums", "outNums",
                      num.half_even(F.col("inNums")).alias("inRounded"),
                      num.truncate(F.col("outNums")).alias("outTruncated"))


@query("error_metrics", with_(TWO) + """,
t AS (SELECT stationID, slot, d.inNums AS ti, d.outNums AS tout, f2.inNums AS pi, f2.outNums AS po
      FROM dense d JOIN f2 USING (stationID, slot) WHERE d.day = DATE '2024-01-30')
SELECT stationID, round(avg(abs(ti - pi)), 9) AS mae_in,
       round(avg(abs(ti - pi) / nullif(abs(ti + pi), 0)), 9) AS relative_in,
       round(avg(abs(tout - po)), 9) AS mae_out, round(avg(abs(tout - po) / nullif(abs(tout + po), 0)), 9) AS relative_out
FROM t GROUP BY 1""".lstrip())
def error_metrics(spark, sf_dir):
    dense = materialise(dense_flow(spark, sf_dir), "dense")
    _, mean = two_forecasts(dense)
    truth = dense.filter(F.col("day") == F.lit(FORECAST_DAY)).select(
        "stationID", "slot", F.col("inNums").alias("trueIn"), F.col("outNums").alias("trueOut"))
    out = forecast.errors(truth.join(mean, ["stationID", "slot"]), {
        "in": ("trueIn", "inNums"), "out": ("trueOut", "outNums")}, ["stationID"])
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c != "stationID"})


@query("row_errors", with_(DENSE) + """
SELECT stationID, slot, abs(d.inNums - p.inNums)::DOUBLE AS absolute,
       abs(d.inNums - p.inNums)::DOUBLE / nullif(abs(d.inNums + p.inNums), 0)::DOUBLE AS relative
FROM (SELECT stationID, slot, inNums FROM dense WHERE day = DATE '2024-01-30') d
JOIN (SELECT stationID, slot, inNums FROM dense WHERE day = DATE '2024-01-29') p USING (stationID, slot)""")
def row_errors(spark, sf_dir):
    dense = materialise(dense_flow(spark, sf_dir), "dense")
    truth = dense.filter(F.col("day") == F.lit(FORECAST_DAY))
    naive, _ = two_forecasts(dense)
    both = truth.alias("t").join(naive.alias("p"), ["stationID", "slot"])
    absolute, relative = forecast.error_columns(F.col("t.inNums"), F.col("p.inNums"))
    return both.select("stationID", "slot", absolute.alias("absolute"), relative.alias("relative"))


@query("early_cap", with_(DENSE) + """
SELECT stationID, strftime(dense.day, '%Y-%m-%d') AS day, slot,
       CASE WHEN slot < 36 THEN least(inNums, 2) ELSE inNums END AS inNums,
       CASE WHEN slot < 36 THEN least(outNums, 2) ELSE outNums END AS outNums FROM dense""")
def early_cap(spark, sf_dir):
    return day_text(forecast.early_cap(dense_flow(spark, sf_dir)))


@query("normalise_label", with_(DENSE) + """,
b AS (SELECT min(inNums) i0, max(inNums) i1, min(outNums) o0, max(outNums) o1 FROM dense)
SELECT stationID, strftime(dense.day, '%Y-%m-%d') AS day, slot, (inNums - i0) / (i1 - i0)::DOUBLE AS inNums_norm,
       (outNums - o0) / (o1 - o0)::DOUBLE AS outNums_norm,
""".lstrip() + ", ".join(f"CASE WHEN weekday = {w} THEN 1 ELSE 0 END AS weekday_{w}" for w in range(7)) + """
FROM dense, b""")
def normalise_label(spark, sf_dir):
    dense = materialise(dense_flow(spark, sf_dir), "dense")
    out = forecast.normalise(dense).withColumn("weekday", tf.weekday(F.col("day")))
    return day_text(network.one_hot(out, "weekday", range(7)).drop("weekday", "inNums", "outNums"))


def _smooth(s: str) -> str:
    """Forecast one step ahead from the three smoothed levels ``{s}1..{s}3`` with a share of 0.3."""
    return (f"round(3 * {s}1 - 3 * {s}2 + {s}3 + (0.3::DOUBLE / (2 * 0.7::DOUBLE * 0.7::DOUBLE)) * (4.5::DOUBLE * {s}1 "
            f"- 7.6::DOUBLE * {s}2 + 3.1::DOUBLE * {s}3) + (0.09::DOUBLE / (2 * 0.7::DOUBLE * 0.7::DOUBLE)) * ({s}1 - 2 * {s}2 + {s}3), 9)")


def _levels(s: str, v: str) -> str:
    one = f"0.3::DOUBLE * x.{v} + 0.7::DOUBLE * s.{s}1"
    two = f"0.3::DOUBLE * ({one}) + 0.7::DOUBLE * s.{s}2"
    return f"{one}, {two}, 0.3::DOUBLE * ({two}) + 0.7::DOUBLE * s.{s}3"


@query("triple_smoothing", "WITH RECURSIVE " + DENSE + """,
x AS MATERIALIZED (SELECT stationID, slot, CAST(date_diff('day', DATE '2024-01-01', dense.day) AS INTEGER) AS k,
             CAST(inNums AS DOUBLE) AS v, CAST(outNums AS DOUBLE) AS u FROM dense),
s AS (SELECT stationID, slot, k, v AS i1, v AS i2, v AS i3, u AS o1, u AS o2, u AS o3 FROM x WHERE k = 0
      UNION ALL
      SELECT s.stationID, s.slot, x.k, """.lstrip() + _levels("i", "v") + ", " + _levels("o", "u") + """
      FROM s JOIN x ON x.stationID = s.stationID AND x.slot = s.slot AND x.k = s.k + 1)
SELECT stationID, slot, """ + _smooth("i") + " AS inNums_smooth, " + _smooth("o") + """ AS outNums_smooth
FROM s WHERE k = 29""")
def triple_smoothing(spark, sf_dir):
    dense = materialise(dense_flow(spark, sf_dir), "dense")
    out = forecast.triple_smoothing(dense, 0.3).join(forecast.triple_smoothing(dense, 0.3, column="outNums"), ["stationID", "slot"])
    return out.withColumns({c: F.round(c, 9) for c in ("inNums_smooth", "outNums_smooth")})


@query("week_over_week", with_(DENSE) + """
SELECT stationID, strftime(d, '%Y-%m-%d') AS day, slot, inNums, outNums, i AS inNums_week, inNums - i AS inNums_change,
       o AS outNums_week, outNums - o AS outNums_change
FROM (SELECT stationID, dense.day AS d, slot, inNums, outNums, lag(inNums, 7) OVER w AS i, lag(outNums, 7) OVER w AS o
      FROM dense WINDOW w AS (PARTITION BY stationID, slot ORDER BY dense.day)) WHERE i IS NOT NULL""")
def week_over_week(spark, sf_dir):
    return day_text(forecast.week_over_week(dense_flow(spark, sf_dir)))


@query("recent_training_days", with_(DENSE) + """
SELECT stationID, strftime(flow.day, '%Y-%m-%d') AS day, slot, inNums, outNums FROM flow
WHERE day BETWEEN DATE '2024-01-22' AND DATE '2024-01-26' OR day = DATE '2024-01-29'""")
def recent_training_days(spark, sf_dir):
    days = [dt.date(2024, 1, d) for d in (22, 23, 24, 25, 26, 29)]
    return day_text(forecast.recent_days(flow.slot_flow(forecast.covering(swipes(spark, sf_dir), days)), days))


@query("paytype_sum", with_(SWIPE) + """
SELECT stationID, slot, round(sum(inNums), 9) AS inNums, round(sum(outNums), 9) AS outNums FROM (
  SELECT stationID, slot, payType, sum(status) / 5.0::DOUBLE AS inNums, (count(*) - sum(status)) / 5.0::DOUBLE AS outNums
  FROM swipe WHERE day IN (DATE '2024-01-23', DATE '2024-01-24', DATE '2024-01-25', DATE '2024-01-26', DATE '2024-01-29')
  GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def paytype_sum(spark, sf_dir):
    """Mean of five days per ticket type, summed to station totals."""
    days = [dt.date(2024, 1, d) for d in (23, 24, 25, 26, 29)]
    rows = forecast.recent_days(flow.slot_flow(forecast.covering(swipes(spark, sf_dir), days), ["payType"]), days)
    per_type = rows.groupBy("stationID", "slot", "payType").agg(
        *[(F.sum(c) / F.lit(5.0)).alias(c) for c in ("inNums", "outNums")])
    return per_type.groupBy("stationID", "slot").agg(
        *[F.round(F.sum(c), 9).alias(c) for c in ("inNums", "outNums")])


@query("forecast_files_blend", with_(TWO) + """
SELECT stationID, TIMESTAMP '2024-01-30' + to_minutes(CAST(slot * 10 AS BIGINT)) AS startTime,
       round((i1 + i2) / 2, 9) AS inNums, round((o1 + o2) / 2, 9) AS outNums, CAST(2 AS BIGINT) AS runs
FROM two""")
def forecast_files_blend(spark, sf_dir):
    """Two runs written as forecast files, all files of the folder read back and averaged per key."""
    from gateflow.session import run_folder
    from gateflow.sources import forecasts as files
    dense = materialise(dense_flow(spark, sf_dir), "dense")
    cells, folder = grid.template(dense, FORECAST_DAY), run_folder(spark, "forecasts")
    for run, one in zip(("previous", "mean5"), two_forecasts(dense)):
        files.write_forecast(forecast.onto_template(cells, one, ["stationID", "slot"]), folder, run)
    runs = files.read_forecasts(spark, folder)
    return runs.groupBy("stationID", "startTime").agg(
        *[F.round(F.avg(c), 9).alias(c) for c in ("inNums", "outNums")], F.count_distinct("run").alias("runs"))
