"""Lag, neighbour, expanding and trailing-window queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gateflow.constants import ANCHOR_CAP_BY_SPAN, TRAILING_WINDOWS_BY_SPAN
from gateflow.functions import timefields as tf
from gateflow.operators import expanding_state, flow, grid, history, trailing
from gateflow.queries.flow import dense_flow, stored_flow, swipes
from gateflow.queries.registry import BUSINESS, DENSE, FIRST_DAY, FLOW, HOLIDAYS, ORIGIN, day_text, query, with_
from gateflow.session import materialise, run_folder
from gateflow.sources import swipes as src


def indexed(df):
    """Business days only, with their index."""
    return grid.business_days(df, HOLIDAYS).withColumn(
        "businessIndex", tf.business_index(F.col("day"), HOLIDAYS, ORIGIN))


def business_flow(spark, sf_dir):
    """Sparse flow of business days with index, weekday, hour and minute."""
    return tf.add_time_fields(indexed(stored_flow(spark, sf_dir)))


def day_index():
    return (F.datediff("day", F.lit(FIRST_DAY)) + 1).cast("int")


@query("business_day_lags", with_(DENSE, BUSINESS) + """
SELECT stationID, idx AS businessIndex, slot, inNums, outNums,
""" + ",\n".join(f"coalesce(lag({c}, {k}) OVER w, -1) AS {c}_lag_{k}" for k in (1, 2, 3) for c in ("inNums", "outNums"))
       + """
FROM dense JOIN business USING (day) WINDOW w AS (PARTITION BY stationID, slot ORDER BY idx)""")
def business_day_lags(spark, sf_dir):
    return history.business_day_lags(indexed(dense_flow(spark, sf_dir))).drop("day").na.fill(-1)


@query("prev_day_join", with_(FLOW) + """
SELECT a.stationID, strftime(a.day, '%Y-%m-%d') AS day, a.slot, a.inNums, a.outNums,
       coalesce(b.inNums, 0) AS inNums_p, coalesce(b.outNums, 0) AS outNums_p,
       coalesce(b.inNums + b.outNums, 0) AS count_p
FROM flow a LEFT JOIN flow b ON a.stationID = b.stationID AND a.slot = b.slot AND b.day + INTERVAL 1 DAY = a.day""")
def prev_day_join(spark, sf_dir):
    rows = flow.slot_flow(swipes(spark, sf_dir)).withColumn("dayIndex", day_index())
    joined = history.previous_day(rows).na.fill(0, ["inNums_p", "outNums_p"])
    return day_text(joined.withColumn("count_p", F.col("inNums_p") + F.col("outNums_p")).drop("dayIndex"))


@query("prev_day_first_repeated", with_(FLOW) + """,
back AS (SELECT stationID, slot, inNums, outNums, day + INTERVAL 1 DAY AS day FROM flow
         UNION ALL SELECT stationID, slot, inNums, outNums, day FROM flow WHERE day = DATE '2024-01-01')
SELECT a.stationID, strftime(a.day, '%Y-%m-%d') AS day, a.slot,
       coalesce(b.inNums, 0) AS inNums_p, coalesce(b.outNums, 0) AS outNums_p
FROM flow a LEFT JOIN back b ON a.stationID = b.stationID AND a.slot = b.slot AND b.day = a.day""".lstrip())
def prev_day_first_repeated(spark, sf_dir):
    rows = flow.slot_flow(swipes(spark, sf_dir)).withColumn("dayIndex", day_index())
    joined = history.previous_day(rows, first_from_itself=True).na.fill(0, ["inNums_p", "outNums_p"])
    return day_text(joined.drop("dayIndex", "inNums", "outNums"))


@query("prev_day_paytype_join", with_(DENSE) + """,
pay AS (SELECT stationID, day, slot, payType, CAST(sum(status) AS BIGINT) AS inNums,
               CAST(count(*) - sum(status) AS BIGINT) AS outNums FROM swipe GROUP BY ALL),
target AS (SELECT c.stationID, c.day, c.slot, CAST(p AS INTEGER) AS payType FROM cells c, generate_series(0, 3) q(p)
           WHERE c.day = DATE '2024-01-30'
           UNION ALL SELECT stationID, day, slot, payType FROM pay WHERE day < DATE '2024-01-30')
SELECT g.stationID, strftime(g.day, '%Y-%m-%d') AS day, g.slot, g.payType, coalesce(b.inNums, 0) AS inNums_p,
       coalesce(b.outNums, 0) AS outNums_p
FROM target g LEFT JOIN pay b ON g.stationID = b.stationID AND g.slot = b.slot AND g.payType = b.payType
  AND b.day + INTERVAL 1 DAY = g.day""".lstrip())
def prev_day_paytype_join(spark, sf_dir):
    """Forecast rows for every ticket type appended to the flow, then the previous day brought over."""
    typed = materialise(flow.slot_flow(swipes(spark, sf_dir), ["payType"]), "typed")
    known = typed.filter(F.col("day") < F.lit(dt.date(2024, 1, 30)))
    ahead = grid.per_pay_type(grid.grid(typed, dt.date(2024, 1, 30), dt.date(2024, 1, 30)))
    rows = known.unionByName(ahead, allowMissingColumns=True).withColumn("dayIndex", day_index())
    joined = history.previous_day(rows, keys=("stationID", "slot", "payType"))
    return day_text(joined.na.fill(0).select("stationID", "day", "slot", "payType", "inNums_p", "outNums_p"))


@query("neighbour_slots", with_(DENSE) + """
SELECT stationID, strftime(dense.day, '%Y-%m-%d') AS day, slot, inNums, outNums,
       coalesce(lag(inNums) OVER w, -1) AS "inNums_1", coalesce(lead(inNums) OVER w, -1) AS "inNums_-1",
       coalesce(lag(outNums) OVER w, -1) AS "outNums_1", coalesce(lead(outNums) OVER w, -1) AS "outNums_-1"
FROM dense WINDOW w AS (PARTITION BY stationID, dense.day ORDER BY slot)""")
def neighbour_slots(spark, sf_dir):
    return day_text(history.neighbour_slots(dense_flow(spark, sf_dir)).na.fill(-1))


LABEL_DAYS = [dt.date(2024, 1, 9), dt.date(2024, 1, 16), dt.date(2024, 1, 23), dt.date(2024, 1, 30)]


@query("last5_days", with_(DENSE) + """,
labels AS (SELECT unnest([DATE '2024-01-09', DATE '2024-01-16', DATE '2024-01-23', DATE '2024-01-30']) AS labelDay)
SELECT stationID, slot, strftime(labelDay, '%Y-%m-%d') AS labelDay,
""" .lstrip() + ",\n".join(
    f"max(inNums) FILTER (k = {i}) AS In{i}, max(outNums) FILTER (k = {i}) AS out{i}, "
    f"CAST(max(g) FILTER (k = {i}) AS INTEGER) AS gap{i}" for i in range(1, 6)) + """
FROM (SELECT dense.*, labelDay, date_diff('day', dense.day, labelDay) AS g,
             row_number() OVER (PARTITION BY stationID, slot, labelDay ORDER BY dense.day DESC) AS k
      FROM dense JOIN labels ON dense.day < labelDay) WHERE k <= 5
GROUP BY stationID, slot, labelDay""")
def last5_days(spark, sf_dir):
    return day_text(history.last_days_wide(dense_flow(spark, sf_dir), LABEL_DAYS))


@query("rolling_mean", with_(DENSE) + """
SELECT stationID, strftime(dense.day, '%Y-%m-%d') AS day, slot,
       CASE WHEN count(*) OVER w = 2 THEN avg(inNums) OVER w ELSE 0 END AS inNums_roll2,
       CASE WHEN count(*) OVER w = 2 THEN avg(outNums) OVER w ELSE 0 END AS outNums_roll2
FROM dense WINDOW w AS (PARTITION BY stationID ORDER BY dense.day, slot ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def rolling_mean(spark, sf_dir):
    return day_text(history.rolling_mean(dense_flow(spark, sf_dir)).drop("inNums", "outNums"))


@query("peaks_valleys", with_(DENSE) + " UNION ALL ".join(f"""
SELECT * FROM (
  SELECT stationID, strftime(dense.day, '%Y-%m-%d') AS day, slot, '{c}' AS flow, {c} AS value,
         CASE WHEN {c} > lag({c}) OVER w AND {c} > lead({c}) OVER w THEN 'peak'
              WHEN {c} < lag({c}) OVER w AND {c} < lead({c}) OVER w THEN 'valley' END AS kind
  FROM dense WINDOW w AS (PARTITION BY stationID, dense.day ORDER BY slot)) WHERE kind IS NOT NULL""" for c in ("inNums", "outNums")))
def peaks_valleys(spark, sf_dir):
    dense = materialise(dense_flow(spark, sf_dir), "dense")
    both = [history.peaks_valleys(dense, c).select("stationID", "day", "slot", F.lit(c).alias("flow"), F.col(c).alias("value"), "kind")
            for c in ("inNums", "outNums")]
    return day_text(both[0].unionByName(both[1]))


_EXPANDING = {"h": "hour", "hm": "hour, minute", "wh": "weekday, hour", "whm": "weekday, hour, minute"}
_EXPANDING_NAMES = [f"{p}_{g}_{s}" for g in _EXPANDING for p in ("in", "out") for s in ("max", "min", "mean")]
_EXPANDING_SQL = "SELECT stationID, day, slot, " + ", ".join(
    f"{fn}({p}Nums) OVER w{g} AS {p}_{g}_{s}" for g in _EXPANDING for p in ("in", "out")
    for s, fn in (("max", "max"), ("min", "min"), ("mean", "avg"))) + " FROM flow WINDOW " + ", ".join(
    f"w{g} AS (PARTITION BY stationID, {k} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    for g, k in _EXPANDING.items())


@query("expanding_stats", with_(FLOW, f"e AS ({_EXPANDING_SQL})") + """
SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM e""")
def expanding_stats(spark, sf_dir):
    rows = tf.add_time_fields(flow.slot_flow(swipes(spark, sf_dir)))
    return day_text(history.expanding_stats(rows).drop("weekday", "hour", "minute", "inNums", "outNums"))


@query("expanding_incremental", with_(FLOW, f"e AS ({_EXPANDING_SQL})") + """
SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM e""")
def expanding_incremental(spark, sf_dir):
    """The same statistics from daily files, fed one at a time: a step reads its own file and the state before it."""
    files, folder = run_folder(spark, "swipes"), run_folder(spark, "state")
    src.write_swipe_files(swipes(spark, sf_dir), files)
    days = [r[0] for r in src.read_swipe_files(spark, files).select("fileDate").distinct().orderBy("fileDate").collect()]
    for previous, day in zip([None, *days], days):
        rows = tf.add_time_fields(flow.slot_flow(src.read_swipe_files(spark, files, day, day)))
        expanding_state.advance(spark, folder, previous, day, rows)
    rows = tf.add_time_fields(flow.slot_flow(src.read_swipe_files(spark, files)))
    out = expanding_state.attach(rows, spark.read.parquet(folder), extra=["day"])
    return day_text(out.drop("weekday", "hour", "minute", "inNums", "outNums"))


@query("expanding_prev_day", with_(FLOW, f"e AS ({_EXPANDING_SQL})") + """
SELECT f.stationID, strftime(f.day, '%Y-%m-%d') AS day, f.slot, f.inNums, f.outNums,
""" + ", ".join(f"coalesce(e.{c}, 0) AS {c}_p" for c in _EXPANDING_NAMES) + """
FROM flow f LEFT JOIN e ON e.stationID = f.stationID AND e.slot = f.slot AND e.day + INTERVAL 1 DAY = f.day""")
def expanding_prev_day(spark, sf_dir):
    rows = tf.add_time_fields(flow.slot_flow(swipes(spark, sf_dir))).withColumn("dayIndex", day_index())
    shifted = history.previous_day(history.expanding_stats(rows), _EXPANDING_NAMES)
    return day_text(shifted.select("stationID", "day", "slot", "inNums", "outNums",
                                   *[F.coalesce(f"{c}_p", F.lit(0)).alias(f"{c}_p") for c in _EXPANDING_NAMES]))


_WIDE = [f"{side}{i}" for i in range(1, 6) for side in ("In", "out")]


@query("wide_days_features", with_(DENSE) + """,
labels AS (SELECT unnest([DATE '2024-01-09', DATE '2024-01-16', DATE '2024-01-23', DATE '2024-01-30']) AS labelDay),
w AS (SELECT stationID, slot, labelDay,
""".lstrip() + ",\n".join(
    f"max(inNums) FILTER (k = {i}) AS In{i}, max(outNums) FILTER (k = {i}) AS out{i}, "
    f"CAST(max(g) FILTER (k = {i}) AS INTEGER) AS gap{i}" for i in range(1, 6)) + """
  FROM (SELECT dense.*, labelDay, date_diff('day', dense.day, labelDay) AS g,
               row_number() OVER (PARTITION BY stationID, slot, labelDay ORDER BY dense.day DESC) AS k
        FROM dense JOIN labels ON dense.day < labelDay)
  WHERE k <= 5 GROUP BY 1, 2, 3)
SELECT w.* EXCLUDE (l), """ + ", ".join(f'coalesce(lag({c}) OVER n, -1) AS "{c}_1", coalesce(lead({c}) OVER n, -1) AS "{c}_-1"'
                            for c in _WIDE) + """,
       d.inNums AS labelin, d.outNums AS labelout
FROM (SELECT * REPLACE (strftime(labelDay, '%Y-%m-%d') AS labelDay), labelDay AS l FROM w) w
JOIN dense d ON d.stationID = w.stationID AND d.slot = w.slot AND d.day = w.l
WINDOW n AS (PARTITION BY w.stationID, w.l ORDER BY w.slot)""")
def wide_days_features(spark, sf_dir):
    """Five days back, their neighbour slots and the label of each label day."""
    from gateflow.plans import wide_days
    table = wide_days.feature_table(dense_flow(spark, sf_dir), LABEL_DAYS)
    return day_text(table.withColumnRenamed("day", "labelDay").na.fill(-1))


_SQL_STAT = {"mean": "avg", "std": "stddev_samp", "median": "median", "max": "max", "min": "min", "var": "var_samp"}
_ROUNDED = ("std", "var")


def _trailing_sql(spec, windows, labels: str, anchors: str, first: int = 1, extra: str = "") -> str:
    """Trailing statistics by range join: one subquery per grain and window."""
    ctes, joins, cols = [], [], []
    for g, stats in spec.items():
        keys = ", ".join(f"h.{k}" for k in trailing.GRAINS[g])
        for n in windows:
            aggs = ", ".join(f"{_SQL_STAT[s]}(h.{c}) AS {c}_{s}_{g}_{n}" for c in ("inNums", "outNums") for s in stats)
            ctes.append(f"t_{g}_{n} AS (SELECT anchor, {keys}, {aggs} FROM hist h JOIN anchors "
                        f"ON h.idx < anchor AND h.idx >= anchor - {n} GROUP BY anchor, {keys})")
            joins.append(f"LEFT JOIN t_{g}_{n} USING (anchor, {', '.join(trailing.GRAINS[g])})")
            for c in ("inNums", "outNums"):
                for s in stats:
                    name = f"{c}_{s}_{g}_{n}"
                    value = f"coalesce({name}, 0)"
                    value = f"round({value}, 6)" if s in _ROUNDED else value
                    cols.append(f"CASE WHEN anchor - {n} >= {first} THEN CAST({value} AS DOUBLE) END AS {name}")
    return (with_(DENSE, BUSINESS, "hist AS (SELECT flow.*, idx FROM flow JOIN business USING (day))",
                  f"anchors AS ({anchors})", f"labels AS ({labels})", *ctes)
            + f"SELECT stationID, idx AS businessIndex, slot, anchor, {extra}" + ",\n".join(cols)
            + " FROM labels " + "\n".join(joins))


def _trailing_output(df, extra=()):
    """Window columns as doubles, deviations rounded like in the statement."""
    keys = ["stationID", "businessIndex", "slot", "anchor", *extra]
    drop = {"day", "weekday", "hour", "minute", "inNums", "outNums", *keys}
    out = []
    for c in df.columns:
        if c not in drop:
            value = f"cast({c} AS double)"
            out.append(f"round({value}, 6) AS {c}" if any(f"_{s}_" in c for s in _ROUNDED) else f"{value} AS {c}")
    return df.selectExpr(*keys, *out)


_STAT_SPEC = {"s": list(_SQL_STAT), "s_h_m": ["mean"], "s_w_h": list(_SQL_STAT),
              "s_w_h_m": ["mean", "median", "max", "min"]}


@query("trailing_stats", _trailing_sql(
    _STAT_SPEC, (1, 3, 5, 10, 15), "SELECT *, 21 AS anchor FROM hist WHERE idx = 21", "SELECT 21 AS anchor"))
def trailing_stats(spark, sf_dir):
    """Statistics of the last 1 to 15 business days for the rows of the forecast day."""
    rows = business_flow(spark, sf_dir)
    labels = rows.filter("businessIndex = 21").withColumn("anchor", F.lit(21))
    return _trailing_output(trailing.add_trailing_stats(labels, rows, [21], spec=_STAT_SPEC))


_SPAN3_ALL = ", ".join(str(a) for a in trailing.anchors_before(21, 3))


@query("anchor_training_set", _trailing_sql(
    trailing.DEFAULT_SPEC, (1, 3, 5, 10, 15),
    f"SELECT h.*, anchor FROM hist h JOIN anchors ON h.idx >= anchor AND h.idx < anchor + 3 AND h.idx < 21",
    f"SELECT unnest([{_SPAN3_ALL}]) AS anchor"))
def anchor_training_set(spark, sf_dir):
    """All anchors three days apart, label rows of the three days after each, every grain."""
    return _trailing_output(trailing.anchor_training_set(business_flow(spark, sf_dir), span=3, end=21))


def _slip_labels(span: int) -> tuple[str, str]:
    cap = ANCHOR_CAP_BY_SPAN[span]
    train, train_all = (trailing.anchors_before(e, span, cap=cap) for e in (20, 21))
    anchors = sorted({*train, *train_all, 20, 21})

    def part(name, end, found):
        return (f"SELECT h.*, anchor, '{name}' AS part FROM hist h JOIN anchors ON h.idx >= anchor "
                f"AND h.idx < anchor + {span} AND h.idx < {end} WHERE anchor IN ({', '.join(map(str, found))})")

    labels = " UNION ALL ".join([part("train", 20, train), part("train_all", 21, train_all),
                                 "SELECT *, 20, 'valid' FROM hist WHERE idx = 20",
                                 "SELECT *, 21, 'test' FROM hist WHERE idx = 21"])
    return labels, f"SELECT unnest([{', '.join(map(str, anchors))}]) AS anchor"


@query("trailing_stats_by_slip", _trailing_sql(
    trailing.SLIP_SPEC, TRAILING_WINDOWS_BY_SPAN[2], *_slip_labels(2), extra="part, "))
def trailing_stats_by_slip(spark, sf_dir):
    """Capped variant with two-day spans: train, train-all, validation and test rows."""
    return _slip_output(spark, sf_dir, 2)


def _slip_output(spark, sf_dir, span):
    rows = business_flow(spark, sf_dir)
    return _trailing_output(trailing.slip_sets(rows, span, 20, 21, cap=ANCHOR_CAP_BY_SPAN[span]), ["part"])


def _register_slip(span: int) -> None:
    @query(f"trailing_stats_by_slip_{span}", _trailing_sql(
        trailing.SLIP_SPEC, TRAILING_WINDOWS_BY_SPAN[span], *_slip_labels(span), extra="part, "))
    def slip(spark, sf_dir):
        return _slip_output(spark, sf_dir, span)


for _span in (1, 3, 5):
    _register_slip(_span)


def _register_anchor_set(span: int) -> None:
    found = ", ".join(str(a) for a in trailing.anchors_before(21, span))

    @query(f"anchor_training_set_{span}", _trailing_sql(
        trailing.DEFAULT_SPEC, (1, 3, 5, 10, 15),
        f"SELECT h.*, anchor FROM hist h JOIN anchors ON h.idx >= anchor AND h.idx < anchor + {span} AND h.idx < 21",
        f"SELECT unnest([{found}]) AS anchor"))
    def anchor_set(spark, sf_dir):
        return _trailing_output(trailing.anchor_training_set(business_flow(spark, sf_dir), span=span, end=21))


for _span in (2, 5, 7):
    _register_anchor_set(_span)


_DEVICE = ["dID_of_sID", "dID_of_sID_h", "dID_of_sID_hm"] + [
    f"{side}DID_h_{s}" for side in ("in", "out") for s in ("max", "min", "mean")]
_CARRIED = ["inNums", "outNums", *_DEVICE, "inNums_log", "outNums_log", *_EXPANDING_NAMES]


@query("total_flow_features", with_(DENSE, f"e AS ({_EXPANDING_SQL.replace('FROM flow', 'FROM past')})").replace(
    "e AS (SELECT", "past AS (SELECT * FROM flow WHERE day < DATE '2024-01-30'), e AS (SELECT") + """,
dev AS (SELECT stationID, day, hour, deviceID, sum(status) AS i, count(*) - sum(status) AS o FROM swipe GROUP BY ALL),
load AS (SELECT stationID, day, hour, max(i) AS inDID_h_max, min(i) AS inDID_h_min, avg(i) AS inDID_h_mean,
                max(o) AS outDID_h_max, min(o) AS outDID_h_min, avg(o) AS outDID_h_mean FROM dev GROUP BY 1, 2, 3),
a AS (SELECT stationID, day, count(DISTINCT deviceID) AS dID_of_sID FROM swipe GROUP BY 1, 2),
b AS (SELECT stationID, day, hour, count(DISTINCT deviceID) AS dID_of_sID_h FROM swipe GROUP BY 1, 2, 3),
c AS (SELECT stationID, day, slot, count(DISTINCT deviceID) AS dID_of_sID_hm FROM swipe GROUP BY 1, 2, 3),
full_row AS (
  SELECT p.*, load.* EXCLUDE (stationID, day, hour), dID_of_sID, dID_of_sID_h, dID_of_sID_hm,
         CASE WHEN inNums > 0 THEN 1 + log2(inNums) ELSE 0 END AS inNums_log,
         CASE WHEN outNums > 0 THEN 1 + log2(outNums) ELSE 0 END AS outNums_log, e.* EXCLUDE (stationID, day, slot)
  FROM past p JOIN load USING (stationID, day, hour) JOIN a USING (stationID, day) JOIN b USING (stationID, day, hour)
  JOIN c USING (stationID, day, slot) JOIN e USING (stationID, day, slot)),
target AS (SELECT stationID, day, slot, inNums, outNums FROM past
           UNION ALL SELECT stationID, day, slot, NULL, NULL FROM cells WHERE day = DATE '2024-01-30')
SELECT t.stationID, strftime(t.day, '%Y-%m-%d') AS day, t.slot, CAST(isodow(t.day) AS INTEGER) AS week,
       CASE WHEN isodow(t.day) >= 6 THEN 1 ELSE 0 END AS weekend, CAST(t.slot // 6 AS INTEGER) AS hour,
       CAST(t.slot % 6 * 10 AS INTEGER) AS minute,
       CAST(date_diff('day', DATE '2024-01-01', t.day) AS INTEGER) AS daySinceFirst,
       CAST(t.inNums AS DOUBLE) AS inNums, CAST(t.outNums AS DOUBLE) AS outNums,
       CAST(f.inNums AS DOUBLE) / nullif(CAST(f.outNums AS DOUBLE), 0) AS ratio_p,
""" + ", ".join(f"round(CAST(f.{c} AS DOUBLE), 9) AS {c}_p" for c in _CARRIED) + """
FROM target t LEFT JOIN full_row f
  ON f.stationID = t.stationID AND f.slot = t.slot AND f.day + INTERVAL 1 DAY = t.day""")
def total_flow_features(spark, sf_dir):
    """The whole feature table of the total-flow forecast."""
    from gateflow.plans import total_flow
    table = total_flow.feature_table(swipes(spark, sf_dir), FIRST_DAY, dt.date(2024, 1, 30)).drop("dayIndex")
    rounded = {f"{c}_p": F.expr(f"round(cast({c}_p AS double), 9)") for c in _CARRIED}
    return day_text(table.withColumns({**rounded, "inNums": F.col("inNums").cast("double"),
                                       "outNums": F.col("outNums").cast("double")}))


@query("lagged_group_stats", with_(DENSE, BUSINESS) + """,
g AS (SELECT stationID, weekday, hour, max(inNums) AS mx, avg(outNums) AS av FROM dense WHERE day < DATE '2024-01-26'
      GROUP BY 1, 2, 3)
SELECT stationID, idx AS businessIndex, slot,
""".lstrip() + ", ".join(f"CAST(lag(mx, {k}) OVER n AS DOUBLE) AS mx_lag_{k}, lag(av, {k}) OVER n AS av_lag_{k}"
                         for k in (1, 2, 3)) + """
FROM dense d JOIN business USING (day) LEFT JOIN g USING (stationID, weekday, hour)
WINDOW n AS (PARTITION BY stationID, slot ORDER BY idx)""")
def lagged_group_stats(spark, sf_dir):
    """Weekday-hour statistics of past days, lagged along the business days like the flow itself."""
    from gateflow.operators import stats
    rows = tf.add_time_fields(dense_flow(spark, sf_dir))
    known = rows.filter(F.col("day") < F.lit(dt.date(2024, 1, 26)))
    table = stats.group_stats(known, ["stationID", "weekday", "hour"], {"mx": ("inNums", "max"), "av": ("outNums", "mean")})
    joined = indexed(rows.join(table, ["stationID", "weekday", "hour"], "left"))
    lagged = history.business_day_lags(joined, ["mx", "av"])
    return lagged.select("stationID", "businessIndex", "slot", *[
        F.col(f"{c}_lag_{k}").cast("double").alias(f"{c}_lag_{k}") for k in (1, 2, 3) for c in ("mx", "av")])
