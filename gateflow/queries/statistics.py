"""Grouped statistics and derived feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gateflow.functions import numeric as num
from gateflow.functions import timefields as tf
from gateflow.operators import flow, history, stats
from gateflow.queries.flow import dense_flow, stored_flow, swipes
from gateflow.queries.registry import DENSE, FIRST_DAY, FLOW, FORECAST_DAY, day_text, query, with_
from gateflow.session import materialise

_FAMILY = {"ID_dh": ["stationID", "weekday", "hour"], "ID_d": ["stationID", "weekday"], "ID": ["stationID"],
           "d": ["day"]}
_BASE = {"whm": ["stationID", "weekday", "slot"], "wh": ["stationID", "weekday", "hour"], "h": ["stationID", "hour"]}
_FN = {"max": "max", "min": "min", "mean": "avg", "sum": "sum"}


def _family_sql(family, columns, kinds, source, target) -> str:
    """One grouped subquery per grain, joined to the target rows."""
    ctes, joins, cols = [], [], []
    for tag, grain in family.items():
        aggs = ", ".join(f"{_FN[s]}({c}) AS {c}_{tag}_{s}" for c in columns for s in kinds)
        ctes.append(f"g_{tag} AS (SELECT {', '.join(grain)}, {aggs} FROM {source} GROUP BY {', '.join(grain)})")
        joins.append(f"LEFT JOIN g_{tag} USING ({', '.join(grain)})")
        cols += [f"CAST(coalesce({c}_{tag}_{s}, -1) AS {'DOUBLE' if s == 'mean' else 'BIGINT'}) AS {c}_{tag}_{s}"
                 for c in columns for s in kinds]
    return (", " + ", ".join(ctes) + " SELECT stationID, strftime(x.day, '%Y-%m-%d') AS day, slot, "
            + ", ".join(cols) + f" FROM {target} x " + " ".join(joins))


@query("group_stats", "WITH " + DENSE + _family_sql(
    _FAMILY, ("inNums", "outNums"), ("max", "min", "mean", "sum"),
    "(SELECT * FROM dense WHERE day < DATE '2024-01-30')", "dense"))
def group_stats(spark, sf_dir):
    """Weekday-hour, weekday, station and day statistics without the forecast day, on all rows."""
    rows = tf.add_time_fields(dense_flow(spark, sf_dir))
    known = rows.filter(F.col("day") < F.lit(FORECAST_DAY))
    return day_text(stats.add_group_family(rows, known, _FAMILY)
                    .drop("weekday", "hour", "minute", "inNums", "outNums").na.fill(-1))


@query("baseline_stats", "WITH " + FLOW + ", f3 AS (SELECT *, inNums + outNums AS total FROM flow)" + _family_sql(
    _BASE, ("inNums", "outNums", "total"), ("max", "min", "mean"),
    "(SELECT * FROM f3 WHERE day < DATE '2024-01-30')", "f3"))
def baseline_stats(spark, sf_dir):
    """Entries, exits and total flow at weekday-slot, weekday-hour and hour grain."""
    rows = tf.add_time_fields(stored_flow(spark, sf_dir)).withColumn(
        "total", F.col("inNums") + F.col("outNums"))
    known = rows.filter(F.col("day") < F.lit(FORECAST_DAY))
    columns = ("inNums", "outNums", "total")
    return day_text(stats.add_group_family(rows, known, _BASE, columns, ("max", "min", "mean"))
                    .drop("weekday", "hour", "minute", *columns).na.fill(-1))


_TEN = ["count", "nunique", "mean", "std", "median", "max", "min", "sum", "var", "quantile"]


@query("feat_stats", with_(FLOW) + """,
t AS (SELECT stationID, hour, count(inNums) AS c, count(DISTINCT inNums) AS n, avg(inNums) AS m,
             stddev_samp(inNums) AS s, median(inNums) AS md, max(inNums) AS mx, min(inNums) AS mn,
             sum(inNums) AS sm, var_samp(inNums) AS v, quantile_cont(inNums, 0.25) AS q
      FROM flow WHERE day < DATE '2024-01-16' GROUP BY 1, 2)
SELECT stationID, strftime(f.day, '%Y-%m-%d') AS day, slot,
       coalesce(c, 0) AS inNums_stationID_hour_count, coalesce(n, 0) AS inNums_stationID_hour_nunique,
       coalesce(m, 0) AS inNums_stationID_hour_mean, round(coalesce(s, 0), 6) AS inNums_stationID_hour_std,
       coalesce(md, 0) AS inNums_stationID_hour_median, coalesce(mx, 0) AS inNums_stationID_hour_max,
       coalesce(mn, 0) AS inNums_stationID_hour_min, CAST(coalesce(sm, 0) AS BIGINT) AS inNums_stationID_hour_sum,
       round(coalesce(v, 0), 6) AS inNums_stationID_hour_var, coalesce(q, 0) AS inNums_stationID_hour_quantile
FROM flow f LEFT JOIN t USING (stationID, hour) WHERE f.day >= DATE '2024-01-16'""".lstrip())
def feat_stats(spark, sf_dir):
    """All ten statistics of the first half of the month on the rows of the second half."""
    import datetime as dt
    rows = tf.add_time_fields(stored_flow(spark, sf_dir))
    cut = F.lit(dt.date(2024, 1, 16))
    out = stats.add_stats(rows.filter(F.col("day") >= cut), rows.filter(F.col("day") < cut),
                          ["stationID", "hour"], "inNums", _TEN, q=0.25)
    base = "inNums_stationID_hour_"
    return day_text(out.withColumns({base + s: F.round(base + s, 6) for s in ("std", "var")})
                    .drop("weekday", "hour", "minute", "inNums", "outNums"))


@query("station_tiers", with_(FLOW) + """,
i AS (SELECT stationID, avg(m) AS l FROM (SELECT stationID, day, max(inNums) m FROM flow GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT stationID, avg(m) AS l FROM (SELECT stationID, day, max(outNums) m FROM flow GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT stationID, avg(m) AS l FROM (SELECT stationID, day, avg(outNums) m FROM flow GROUP BY 1, 2) GROUP BY 1)
SELECT stationID,
  CAST(CASE WHEN stationID = 9 THEN 4 WHEN i.l > 2.0 THEN 3 WHEN i.l > 1.7 THEN 2 WHEN i.l > 1.5 THEN 1 ELSE 0 END
       AS INTEGER) AS tier_in,
  CAST(CASE WHEN stationID = 9 THEN 4 WHEN o.l > 2.2 THEN 3 WHEN o.l > 2.0 THEN 2 WHEN o.l > 1.9 THEN 1 ELSE 0 END
       AS INTEGER) AS tier_out,
  CAST(CASE WHEN stationID = 9 THEN 4 WHEN a.l > 0.7 THEN 3 WHEN a.l > 0.65 THEN 2 WHEN a.l > 0.6 THEN 1 ELSE 0 END
       AS INTEGER) AS tier_mean_out
FROM i JOIN o USING (stationID) JOIN a USING (stationID)""".lstrip())
def station_tiers(spark, sf_dir):
    """Tiers with bounds that fit the small counts of the driver tables."""
    return stats.station_tiers(flow.slot_flow(swipes(spark, sf_dir)), {
        "tier_in": ("inNums", "max", (1.5, 1.7, 2.0)), "tier_out": ("outNums", "max", (1.9, 2.0, 2.2)),
        "tier_mean_out": ("outNums", "mean", (0.6, 0.65, 0.7))})


@query("night_profile", with_(FLOW) + """
SELECT stationID, slot, count(i) AS days_in, coalesce(avg(i), 0) AS mean_in, count(o) AS days_out,
       coalesce(avg(o), 0) AS mean_out
FROM (SELECT stationID, slot,
             CASE WHEN (slot * 10 >= 1420 OR slot * 10 <= 320) AND inNums <> 0 THEN inNums END AS i,
             CASE WHEN slot * 10 <= 350 AND outNums <> 0 THEN outNums END AS o FROM flow)
GROUP BY 1, 2 HAVING count(i) > 0 OR count(o) > 0""")
def night_profile(spark, sf_dir):
    return stats.night_profile(flow.slot_flow(swipes(spark, sf_dir)))


# Grain of each transferred mean: distinct devices at five grains, largest device and ticket type at three.
_TRANSFERS = {
    "devices_s": ["stationID"], "devices_s_h": ["stationID", "hour"], "devices_s_h_m": ["stationID", "hour", "minute"],
    "devices_s_w_h": ["stationID", "weekday", "hour"], "devices_s_w_h_m": ["stationID", "weekday", "hour", "minute"],
    "device_s": ["stationID"], "device_s_h": ["stationID", "hour"], "device_s_w_h": ["stationID", "weekday", "hour"],
    "pay_s": ["stationID"], "pay_s_h": ["stationID", "hour"], "pay_s_w_h": ["stationID", "weekday", "hour"]}
_TRANSFER_FN = {"devices": "count(DISTINCT deviceID)", "device": "max(deviceID)", "pay": "max(payType)"}


def _transfer_sql() -> str:
    past, joins, shown = [], [], []
    for name, grain in _TRANSFERS.items():
        keys = ", ".join(grain)
        past.append(f"x_{name} AS (SELECT {keys}, {_TRANSFER_FN[name.split('_')[0]]} AS v FROM swipe WHERE day < DATE '2024-01-30' GROUP BY ALL)")
        past.append(f"m_{name} AS (SELECT {keys}, avg(v) AS {name} FROM flow JOIN x_{name} USING ({keys}) WHERE flow.day < DATE '2024-01-30' GROUP BY {keys})")
        joins.append(f"LEFT JOIN m_{name} USING ({keys})")
        shown.append(f"coalesce({name}, 0) AS {name}")
    return (with_(DENSE, *past) + "SELECT stationID, slot, " + ", ".join(shown) + " FROM dense d " + " ".join(joins)
            + " WHERE d.day = DATE '2024-01-30'")


@query("history_mean_transfer", _transfer_sql())
def history_mean_transfer(spark, sf_dir):
    """The statistics of past days on their rows, their means at the same grains on the rows of the forecast day."""
    from gateflow.operators import grid
    fields = flow.with_grain_fields(swipes(spark, sf_dir))
    # a row per device and slot has all that the coarser grains need; the swipes are read once and never copied
    sw = materialise(fields.groupBy("stationID", "day", "slot", "weekday", "hour", "minute", "deviceID").agg(F.max("payType").alias("payType")), "fields")
    past = sw.filter(F.col("day") < F.lit(FORECAST_DAY))
    everything = sw.select("stationID", "day", "slot", "weekday", "hour", "minute").distinct()
    rows = everything.filter(F.col("day") < F.lit(FORECAST_DAY))
    aggs = {"devices": F.count_distinct("deviceID"), "device": F.max("deviceID"), "pay": F.max("payType")}
    for name, grain in _TRANSFERS.items():
        rows = rows.join(past.groupBy(*grain).agg(aggs[name.split("_")[0]].alias(name)), grain, "left")
    target = tf.add_time_fields(grid.grid(everything, FORECAST_DAY, FORECAST_DAY))
    out = stats.transfer_means(target, materialise(rows, "history"), {n: (n, g) for n, g in _TRANSFERS.items()})
    return out.na.fill(0).drop("day", "weekday", "hour", "minute")


@query("log_ratio_features", with_(FLOW) + """
SELECT a.stationID, strftime(a.day, '%Y-%m-%d') AS day, a.slot,
       CASE WHEN a.inNums > 0 THEN round(1 + log2(a.inNums), 9) ELSE 0 END AS inNums_log,
       CASE WHEN a.outNums > 0 THEN round(1 + log2(a.outNums), 9) ELSE 0 END AS outNums_log,
       CAST(b.inNums AS DOUBLE) / nullif(CAST(b.outNums AS DOUBLE), 0) AS ratio_p,
       a.inNums + a.outNums AS total, coalesce(b.inNums + b.outNums, 0) AS total_p
FROM flow a LEFT JOIN flow b ON a.stationID = b.stationID AND a.slot = b.slot AND b.day + INTERVAL 1 DAY = a.day""")
def log_ratio_features(spark, sf_dir):
    rows = flow.slot_flow(swipes(spark, sf_dir)).withColumn("dayIndex", F.datediff("day", F.lit(FIRST_DAY)) + 1)
    rows = history.previous_day(rows)
    total_p = F.coalesce(F.col("inNums_p") + F.col("outNums_p"), F.lit(0))
    return day_text(rows.select(
        "stationID", "day", "slot", F.round(num.log_feature(F.col("inNums")), 9).alias("inNums_log"),
        F.round(num.log_feature(F.col("outNums")), 9).alias("outNums_log"),
        num.ratio(F.col("inNums_p"), F.col("outNums_p")).alias("ratio_p"),
        (F.col("inNums") + F.col("outNums")).alias("total"), total_p.alias("total_p")))


@query("equal_width_bins", with_(FLOW) + """,
b AS (SELECT min(slot * 10) AS lo, max(slot * 10) AS hi, min(inNums) AS l2, max(inNums) AS h2 FROM flow)
SELECT stationID, strftime(flow.day, '%Y-%m-%d') AS day, slot,
       CAST(greatest(0, ceil((slot * 10 - lo) * 5.0::DOUBLE / (hi - lo)) - 1) AS INTEGER) AS hour_minute_cut,
       CAST(greatest(0, ceil((inNums - l2) * 5.0::DOUBLE / (h2 - l2)) - 1) AS INTEGER) AS in_cut
FROM flow, b""".lstrip())
def equal_width_bins(spark, sf_dir):
    """Codes over the global range; the bounds are scalar subqueries, not a joined table."""
    rows = stored_flow(spark, sf_dir).withColumn("hourMinute", F.col("slot") * 10)

    def bound(fn, c):
        return rows.agg(fn(c)).scalar()

    return day_text(rows.select(
        "stationID", "day", "slot",
        num.equal_width_code(F.col("hourMinute"), bound(F.min, "hourMinute"), bound(F.max, "hourMinute"))
        .alias("hour_minute_cut"),
        num.equal_width_code(F.col("inNums"), bound(F.min, "inNums"), bound(F.max, "inNums")).alias("in_cut")))
