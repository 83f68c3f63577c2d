"""Queries on raw swipes and the flow table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gateflow.functions import timefields as tf
from gateflow.operators import flow, grid
from gateflow.plans.naive import naive_forecast as naive_plan
from gateflow.queries.registry import (CLOSED, DENSE, FIRST_DAY, FLOW, FORECAST_DAY, PREVIOUS_DAY, SWIPE, day_text,
                                       query, with_)
from gateflow.session import materialise, run_folder
from gateflow.sources import swipes as src

GRAINS = {
    "s": ["stationID"],
    "s_h": ["stationID", "hour"],
    "s_h_m": ["stationID", "hour", "minute"],
    "s_w_h": ["stationID", "weekday", "hour"],
    "s_w_h_m": ["stationID", "weekday", "hour", "minute"],
}


def swipes(spark, sf_dir, **kw):
    return src.read_event_swipes(spark, sf_dir, **kw)


def stored_flow(spark, sf_dir):
    """The flow table, written once: everything after it starts from files instead of raw swipes."""
    return materialise(flow.slot_flow(swipes(spark, sf_dir)), "flow")


def dense_flow(spark, sf_dir, first=FIRST_DAY, last=FORECAST_DAY):
    rows = stored_flow(spark, sf_dir)
    return grid.densify(rows, grid.grid(rows, first, last))


@query("naive_forecast", with_(SWIPE) + """
SELECT s.stationID, ts0 AS startTime, ts0 + INTERVAL 10 MINUTE AS endTime,
       CAST(coalesce(inNums, 0) AS BIGINT) AS inNums, CAST(coalesce(outNums, 0) AS BIGINT) AS outNums
FROM (SELECT DISTINCT stationID FROM swipe) s
CROSS JOIN generate_series(TIMESTAMP '2024-01-30 00:00:00', TIMESTAMP '2024-01-30 23:50:00', INTERVAL 10 MINUTE) g(ts0)
LEFT JOIN (SELECT stationID, time_bucket(INTERVAL 10 MINUTE, time) + INTERVAL 1 DAY AS t, sum(status) AS inNums,
                  count(*) - sum(status) AS outNums
           FROM swipe WHERE day = DATE '2024-01-29' GROUP BY 1, 2) c ON c.stationID = s.stationID AND c.t = ts0""")
def naive_forecast(spark, sf_dir):
    """From the stored flow: its stations make the template, its previous day the forecast."""
    rows = stored_flow(spark, sf_dir)
    earlier = rows.filter(F.col("day") == F.lit(PREVIOUS_DAY)).withColumn("day", F.lit(FORECAST_DAY))
    return (grid.template(rows, FORECAST_DAY).join(earlier, grid.KEY, "left").na.fill(0, ["inNums", "outNums"])
            .select("stationID", "startTime", "endTime", "inNums", "outNums"))


@query("slot_flow", with_(SWIPE) + """
SELECT stationID, time_bucket(INTERVAL 10 MINUTE, time) AS startTime, CAST(sum(status) AS BIGINT) AS inNums,
       CAST(count(*) - sum(status) AS BIGINT) AS outNums
FROM swipe GROUP BY 1, 2""")
def slot_flow(spark, sf_dir):
    return flow.slot_flow(swipes(spark, sf_dir)).select(
        "stationID", tf.slot_start(F.col("day"), F.col("slot")).alias("startTime"), "inNums", "outNums")


@query("slot_flow_paytype", with_(SWIPE) + """
SELECT stationID, time_bucket(INTERVAL 10 MINUTE, time) AS startTime, payType,
       CAST(sum(status) AS BIGINT) AS inNums, CAST(count(*) - sum(status) AS BIGINT) AS outNums
FROM swipe GROUP BY 1, 2, 3""")
def slot_flow_paytype(spark, sf_dir):
    return flow.slot_flow(swipes(spark, sf_dir), ["payType"]).select(
        "stationID", tf.slot_start(F.col("day"), F.col("slot")).alias("startTime"), "payType", "inNums", "outNums")


@query("dense_grid", with_(DENSE) + """
SELECT stationID, strftime(day, '%Y-%m-%d') AS day, slot, inNums, outNums FROM dense""")
def dense_grid(spark, sf_dir):
    return day_text(dense_flow(spark, sf_dir))


@query("day_sheet", with_(DENSE) + """
SELECT strftime(day, '%Y-%m-%d') AS day, slot,
""" + ",\n".join(
    f"CAST(sum(CASE WHEN stationID = {s} THEN inNums ELSE 0 END) AS BIGINT) AS In_{s}_0, "
    f"CAST(sum(CASE WHEN stationID = {s} THEN outNums ELSE 0 END) AS BIGINT) AS out_{s}_0" for s in range(10)) + """
FROM dense GROUP BY 1, 2""")
def day_sheet(spark, sf_dir):
    return day_text(grid.day_sheet(dense_flow(spark, sf_dir), range(10)))


@query("status_pivot", with_(SWIPE) + """
SELECT stationID, strftime(day, '%Y-%m-%d') AS day, slot, count(*) FILTER (status = 0) AS outNums,
       count(*) FILTER (status = 1) AS inNums
FROM swipe GROUP BY stationID, swipe.day, slot""")
def status_pivot(spark, sf_dir):
    return day_text(flow.status_pivot(swipes(spark, sf_dir)))


@query("time_fields", with_(SWIPE) + """
SELECT event_id, time_bucket(INTERVAL 10 MINUTE, time) AS startTime, strftime(time, '%Y-%m-%d') AS day,
       CAST(month(time) AS INTEGER) AS month, CAST(day(time) AS INTEGER) AS dayOfMonth, hour, minute,
       CAST(minute(time) AS INTEGER) AS fullMinute,
       CAST((minute(time) + 8) // 10 AS INTEGER) AS clip8, slot, CAST(isodow(time) AS INTEGER) AS week,
       weekday, CASE WHEN weekday >= 5 THEN 1 ELSE 0 END AS weekend,
       CASE WHEN hour >= 22 OR hour <= 6 THEN 1 WHEN hour BETWEEN 10 AND 15 THEN 2 WHEN hour BETWEEN 16 AND 18 THEN 4
            WHEN hour BETWEEN 19 AND 21 OR hour = 7 THEN 3 ELSE 5 END AS bandX,
       CASE WHEN hour >= 23 OR hour <= 6 THEN 1 WHEN hour BETWEEN 10 AND 13 THEN 2 WHEN hour BETWEEN 18 AND 22 THEN 3
            WHEN hour BETWEEN 14 AND 17 THEN 4 ELSE 5 END AS bandY,
       CAST(hour * 60 + minute AS INTEGER) AS hourMinute, strftime(time, '%H:%M:%S') AS timeText,
       time + INTERVAL 1 DAY AS nextDay,
       CAST(date_diff('day', DATE '2024-01-01', CAST(time AS DATE)) AS INTEGER) AS daySinceFirst,
       CAST((stationID + 1) * (day(time) * 144 + hour * 6 + minute) AS INTEGER) AS timeRank
FROM swipe""")
def time_fields(spark, sf_dir):
    from gateflow.functions.numeric import time_rank
    sw = swipes(spark, sf_dir)
    t, d = F.col("time"), F.to_date("time")
    hour, minute = F.hour(t), tf.minute_of(tf.slot_in_day(t))
    return sw.select(
        "event_id", tf.floor_time(t).alias("startTime"), F.date_format(t, "yyyy-MM-dd").alias("day"),
        F.month(t).alias("month"), F.dayofmonth(t).alias("dayOfMonth"), hour.alias("hour"), minute.alias("minute"),
        F.minute(t).alias("fullMinute"), tf.slot_in_hour(t, offset=8).alias("clip8"), tf.slot_in_day(t).alias("slot"),
        tf.weekday(d, first=1).alias("week"), tf.weekday(d).alias("weekday"), tf.weekend_flag(d).alias("weekend"),
        tf.service_band(hour, "X").alias("bandX"), tf.service_band(hour, "Y").alias("bandY"),
        tf.minute_of_day(hour, minute).alias("hourMinute"), F.date_format(t, "HH:mm:ss").alias("timeText"),
        tf.rebase(t, 1).alias("nextDay"), tf.days_since_first(d, F.lit(FIRST_DAY)).alias("daySinceFirst"),
        time_rank(F.col("stationID"), F.dayofmonth(t), hour, minute).cast("int").alias("timeRank"),
    )


def _grain_union(select: str, source: str) -> str:
    keys = ["stationID", "hour", "minute", "weekday"]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS grain, "
        + ", ".join(k if k in grain else f"CAST(-1 AS INTEGER) AS {k}" for k in keys)
        + f", {select} FROM {source} GROUP BY {', '.join(grain)}" for name, grain in GRAINS.items())


@query("distinct_devices_grains", with_(SWIPE) + _grain_union("count(DISTINCT deviceID) AS n", "swipe"))
def distinct_devices_grains(spark, sf_dir):
    counts = flow.distinct_counts(flow.with_grain_fields(swipes(spark, sf_dir)), "deviceID", GRAINS)
    return counts.na.fill(-1)  # -1: the key is not part of the grain


_DAY_GRAINS = GRAINS | {"s_d": ["stationID", "day"], "s_d_h": ["stationID", "day", "hour"]}


def _day_grain_sql() -> str:
    parts = []
    for name, grain in _DAY_GRAINS.items():
        shown = [f"{k if k in grain else -1} AS {k}" for k in ("stationID", "weekday", "hour", "minute")]
        day = "strftime(swipe.day, '%Y-%m-%d')" if "day" in grain else "'all'"
        parts.append(f"SELECT '{name}' AS grain, {day} AS day, {', '.join(shown)}, count(DISTINCT deviceID) AS n FROM swipe "
                     f"GROUP BY {', '.join('swipe.day' if k == 'day' else k for k in grain)}")
    return " UNION ALL ".join(parts)


@query("distinct_devices_bitmaps", with_(SWIPE) + _day_grain_sql())
def distinct_devices_bitmaps(spark, sf_dir):
    """Exact device counts of the five grains and of days, from one stored table of bitmaps per slot and day."""
    sets = flow.device_bitmaps(flow.with_grain_fields(swipes(spark, sf_dir)), "deviceID", ["stationID", "day", "weekday", "hour", "minute"])
    counts = flow.distinct_by_bitmaps(materialise(sets, "bitmaps"), _DAY_GRAINS)
    return counts.withColumn("day", F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("all"))).na.fill(-1)


@query("distinct_devices_per_day", with_(FLOW) + """
SELECT stationID, strftime(f.day, '%Y-%m-%d') AS day, slot, a.n AS dID_of_sID, b.n AS dID_of_sID_h,
       c.n AS dID_of_sID_hm
FROM flow f
JOIN (SELECT stationID, day, count(DISTINCT deviceID) n FROM swipe GROUP BY 1, 2) a USING (stationID, day)
JOIN (SELECT stationID, day, hour, count(DISTINCT deviceID) n FROM swipe GROUP BY 1, 2, 3) b
  USING (stationID, day, hour)
JOIN (SELECT stationID, day, slot, count(DISTINCT deviceID) n FROM swipe GROUP BY 1, 2, 3) c
  USING (stationID, day, slot)""")
def distinct_devices_per_day(spark, sf_dir):
    sw = flow.with_grain_fields(swipes(spark, sf_dir))
    rows = flow.slot_flow(sw).withColumn("hour", tf.hour_of(F.col("slot")))
    scoped = flow.add_distinct_counts(rows, sw, "deviceID", {
        "dID_of_sID": ["stationID", "day"], "dID_of_sID_h": ["stationID", "day", "hour"],
        "dID_of_sID_hm": ["stationID", "day", "slot"]})
    return day_text(scoped.select("stationID", "day", "slot", "dID_of_sID", "dID_of_sID_h", "dID_of_sID_hm"))


_TOP_GRAINS = {"s": ["stationID"], "s_h": ["stationID", "hour"], "s_w_h": ["stationID", "weekday", "hour"]}


def _top_sql(name: str, grain: list[str]) -> str:
    keys = ", ".join(grain)
    shown = ", ".join(k if k in grain else f"-1 AS {k}" for k in ("stationID", "weekday", "hour"))
    return f"""SELECT '{name}' AS grain, {shown}, deviceID_max, deviceID_mode, payType_max, payType_mode
FROM (SELECT {keys}, max(deviceID) AS deviceID_max, first(deviceID ORDER BY n DESC, deviceID) AS deviceID_mode
      FROM (SELECT {keys}, deviceID, count(*) n FROM swipe GROUP BY ALL) GROUP BY {keys})
JOIN (SELECT {keys}, max(payType) AS payType_max, first(payType ORDER BY n DESC, payType) AS payType_mode
      FROM (SELECT {keys}, payType, count(*) n FROM swipe GROUP BY ALL) GROUP BY {keys}) USING ({keys})"""


@query("top_device_max_and_mode", with_(SWIPE) + " UNION ALL ".join(_top_sql(n, g) for n, g in _TOP_GRAINS.items()))
def top_device_max_and_mode(spark, sf_dir):
    """Three grains from one stored table of counts at the finest of them; the swipes are read once."""
    finest = _TOP_GRAINS["s_w_h"]
    counts = materialise(flow.value_counts_by(flow.with_grain_fields(swipes(spark, sf_dir)), ["deviceID", "payType"], finest), "counts")
    parts = [flow.top_of_counts(counts, ["deviceID", "payType"], g).select(
        F.lit(n).alias("grain"), *[F.col(k) if k in g else F.lit(-1).alias(k) for k in finest],
        "deviceID_max", "deviceID_mode", "payType_max", "payType_mode") for n, g in _TOP_GRAINS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("largest_devices", with_(SWIPE) + """
SELECT stationID, hour, deviceID, CAST(rk AS INTEGER) AS rank FROM (
  SELECT stationID, hour, deviceID,
         row_number() OVER (PARTITION BY stationID, hour ORDER BY deviceID DESC) AS rk FROM swipe)
WHERE rk <= 3""")
def largest_devices(spark, sf_dir):
    return flow.largest_n(flow.with_grain_fields(swipes(spark, sf_dir)), ["stationID", "hour"], "deviceID", 3)


@query("device_load", with_(SWIPE) + """,
d AS (SELECT stationID, day, hour, deviceID, sum(status) AS i, count(*) - sum(status) AS o FROM swipe GROUP BY ALL)
SELECT stationID, strftime(d.day, '%Y-%m-%d') AS day, hour,
       CAST(max(i) AS BIGINT) AS inDID_h_max, CAST(min(i) AS BIGINT) AS inDID_h_min, avg(i) AS inDID_h_mean,
       CAST(max(o) AS BIGINT) AS outDID_h_max, CAST(min(o) AS BIGINT) AS outDID_h_min, avg(o) AS outDID_h_mean
FROM d GROUP BY stationID, d.day, hour""".lstrip())
def device_load(spark, sf_dir):
    return day_text(flow.device_load(flow.with_grain_fields(swipes(spark, sf_dir))))


@query("resample_30min", with_(SWIPE) + """,
w AS (SELECT time_bucket(INTERVAL 30 MINUTE, time) AS startTime, lineID, count(*) n, sum(status) e
      FROM swipe GROUP BY 1, 2)
SELECT startTime, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(e) AS BIGINT) AS entries,
       first(lineID ORDER BY n DESC, lineID) AS busiestLine
FROM w GROUP BY startTime""".lstrip())
def resample_30min(spark, sf_dir):
    return flow.resample(swipes(spark, sf_dir))


@query("busiest_window_line", with_(SWIPE) + """
SELECT time_bucket(INTERVAL 30 MINUTE, time) AS startTime, lineID, count(*) AS rows
FROM swipe GROUP BY 1, 2 ORDER BY rows DESC, startTime, lineID LIMIT 1""")
def busiest_window_line(spark, sf_dir):
    return flow.busiest_window_line(swipes(spark, sf_dir))


# Event times are cut to whole minutes so that swipes do fall on window boundaries.
_MINUTES = """m AS (SELECT stationID, status, date_trunc('minute', time) AS t FROM swipe)"""


@query("window_boundary_counts", with_(SWIPE, _MINUTES) + """
SELECT stationID, w AS startTime, CAST(sum(status) AS BIGINT) AS inNums,
       CAST(count(*) - sum(status) AS BIGINT) AS outNums
FROM m JOIN generate_series(TIMESTAMP '2023-12-31 23:50:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 10 MINUTE) g(w)
  ON t >= w AND t <= w + INTERVAL 10 MINUTE
GROUP BY 1, 2""")
def window_boundary_counts(spark, sf_dir):
    whole = swipes(spark, sf_dir).withColumn("time", tf.floor_time(F.col("time"), 1))
    return flow.windowed_counts(whole, closed=True)


@query("window_half_open_counts", with_(SWIPE, _MINUTES) + """
SELECT stationID, w AS startTime, CAST(sum(status) AS BIGINT) AS inNums,
       CAST(count(*) - sum(status) AS BIGINT) AS outNums
FROM m JOIN generate_series(TIMESTAMP '2023-12-31 23:50:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 10 MINUTE) g(w)
  ON t >= w AND t < w + INTERVAL 10 MINUTE
GROUP BY 1, 2""")
def window_half_open_counts(spark, sf_dir):
    whole = swipes(spark, sf_dir).withColumn("time", tf.floor_time(F.col("time"), 1))
    return flow.windowed_counts(whole, closed=False)


@query("service_hours_flow", with_(FLOW) + """
SELECT stationID, strftime(flow.day, '%Y-%m-%d') AS day, slot, inNums, outNums FROM flow
WHERE stationID <> 4 AND slot * 10 >= 320""")
def service_hours_flow(spark, sf_dir):
    return day_text(grid.in_service(flow.slot_flow(swipes(spark, sf_dir)), CLOSED))


@query("nonzero_entries", with_(DENSE) + """
SELECT 'inNums' AS flow, stationID, strftime(dense.day, '%Y-%m-%d') AS day, slot, inNums AS value FROM dense
WHERE inNums <> 0 AND (slot * 10 >= 1420 OR slot * 10 <= 320)
UNION ALL
SELECT 'outNums', stationID, strftime(dense.day, '%Y-%m-%d'), slot, outNums FROM dense
WHERE outNums <> 0 AND (slot * 10 >= 1420 OR slot * 10 <= 350)""")
def nonzero_entries(spark, sf_dir):
    """Night slots with entries, and with exits: the band of exits ends later."""
    minute = F.col("slot") * 10
    bands = {"inNums": (minute >= 1420) | (minute <= 320), "outNums": (minute >= 1420) | (minute <= 350)}
    sides = F.array(*[F.when(night & (F.col(c) != 0), F.struct(F.lit(c).alias("flow"), F.col(c).alias("value"))) for c, night in bands.items()])
    rows = dense_flow(spark, sf_dir).select("stationID", "day", "slot", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x"))
    return day_text(rows.select("x.flow", "stationID", "day", "slot", "x.value"))


@query("daily_file_counts", with_(SWIPE) + """
SELECT strftime(swipe.day, '%Y-%m-%d') AS day, count(*) AS rows, CAST(sum(status) AS BIGINT) AS entries,
       count(DISTINCT stationID) AS stations
FROM swipe WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND day NOT IN (DATE '2024-01-06', DATE '2024-01-07')
GROUP BY swipe.day""")
def daily_file_counts(spark, sf_dir):
    """Writes daily CSV files, reads a day range back in one scan and counts rows per file date."""
    import datetime as dt
    folder = run_folder(spark, "swipes")
    src.write_swipe_files(swipes(spark, sf_dir), folder)
    back = src.read_swipe_files(spark, folder, dt.date(2024, 1, 3), dt.date(2024, 1, 20),
                                skip=[dt.date(2024, 1, 6), dt.date(2024, 1, 7)])
    return day_text(back.groupBy(F.col("fileDate").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("status").alias("entries"),
        F.count_distinct("stationID").alias("stations")))


@query("rows_per_day", with_(SWIPE) + """
SELECT strftime(swipe.day, '%Y-%m-%d') AS day, count(*) AS rows FROM swipe GROUP BY swipe.day""")
def rows_per_day(spark, sf_dir):
    return day_text(flow.with_slot(swipes(spark, sf_dir)).groupBy("day").agg(F.count(F.lit(1)).alias("rows")))
