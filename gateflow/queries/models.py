"""Splits, folds, boosted forecasts and the streaming form of the slot flow.

Forecasts of fitted models have no SQL counterpart; their rounds are few so that the whole table is trained on in
seconds. What must hold for any such forecast is said in SQL by the queries whose names end in ``_facts``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gateflow.functions import timefields as tf
from gateflow.operators import grid, model
from gateflow.plans import absolute, anchor_windows, rolling_origin, total_flow, wide_days
from gateflow.queries.flow import dense_flow, stored_flow, swipes
from gateflow.queries.history import _CARRIED, LABEL_DAYS, business_flow, indexed
from gateflow.queries.network import weather_days
from gateflow.queries.registry import (BUSINESS, CLOSED, DENSE, FIRST_DAY, FLOW, FORECAST_DAY, HOLIDAYS, ORIGIN, PREVIOUS_DAY, QUERIES,
                                       SQL, SWIPE, day_text, query, with_)
from gateflow.session import materialise, run_folder

_runs: dict[tuple, list] = {}


def one_run(spark, sf_dir, name, make):
    """The stored tables of a plan: one run of a plan serves all queries on it in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _runs:
        _runs[key] = [materialise(part, name) for part in make(spark, sf_dir)]
    return _runs[key]


# What holds for every forecast of the day: a row per station and slot, bounds, nothing missing, the closed station empty.
FORECAST_FACTS = with_(DENSE) + """
SELECT stationID, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT slot) AS BIGINT) AS slots, CAST(0 AS BIGINT) AS missing,
       CAST(0 AS BIGINT) AS outside, CASE WHEN stationID = 4 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS closedFlow
FROM cells WHERE day = DATE '2024-01-30' GROUP BY stationID"""


def forecast_facts(out):
    flows = ("inNums", "outNums")
    return out.groupBy("stationID").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("startTime").alias("slots"),
        F.count_if(F.col("inNums").isNull() | F.col("outNums").isNull()).alias("missing"),
        F.count_if(F.least(*flows) < 0).alias("outside"),
        F.max(F.when(F.col("stationID").isin(CLOSED), F.abs("inNums") + F.abs("outNums")).otherwise(F.lit(-1.0))).cast("double").alias("closedFlow"))


def _register_facts(name: str) -> None:
    @query(f"{name}_facts", FORECAST_FACTS)
    def facts(spark, sf_dir):
        return forecast_facts(one_run(spark, sf_dir, name, PLANS[name])[0])


QUICK = model.Boosting(rounds=6, rate=0.2, depth=3, patience=3)


@query("kfold_assignment", with_(DENSE, BUSINESS) + """
SELECT stationID, idx AS businessIndex, slot, CAST((stationID * 31 + idx * 7 + slot) % 5 AS INTEGER) AS fold
FROM flow JOIN business USING (day)""")
def kfold_assignment(spark, sf_dir):
    rows = business_flow(spark, sf_dir)
    return rows.select("stationID", "businessIndex", "slot", model.arithmetic_fold(5).alias("fold"))


@query("rolling_origin_splits", with_(DENSE, BUSINESS) + """,
folds AS (SELECT unnest([17, 18, 19, 20]) AS validDay)
SELECT validDay, CASE WHEN idx < validDay THEN 'train' WHEN idx = validDay THEN 'valid' ELSE 'test' END AS part,
       count(*) AS rows, CAST(sum(inNums) AS BIGINT) AS inNums
FROM flow JOIN business USING (day) JOIN folds ON idx <= validDay + 1 GROUP BY 1, 2""".lstrip())
def rolling_origin_splits(spark, sf_dir):
    """Each row names the folds it takes part in; sizes are counted per fold and part."""
    rows = business_flow(spark, sf_dir)
    days = [v for v, _ in model.rolling_splits([17, 18, 19, 20])]
    folds = F.filter(F.array(*[F.lit(d) for d in days]), lambda v: F.col("businessIndex") <= v + 1)
    part = (F.when(F.col("businessIndex") < F.col("validDay"), "train")
            .when(F.col("businessIndex") == F.col("validDay"), "valid").otherwise("test"))
    return rows.withColumn("validDay", F.explode(folds)).groupBy("validDay", part.alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("inNums").alias("inNums"))


@query("fold_errors", with_(DENSE, BUSINESS) + """,
p AS (SELECT stationID, idx, slot, inNums, outNums, lag(inNums) OVER w AS i, lag(outNums) OVER w AS o
      FROM dense JOIN business USING (day) WINDOW w AS (PARTITION BY stationID, slot ORDER BY idx)),
f AS (SELECT (stationID * 31 + idx * 7 + slot) % 5 AS fold, avg(abs(inNums - i)) AS mi, avg(abs(outNums - o)) AS mo FROM p
      WHERE i IS NOT NULL GROUP BY 1)
SELECT 'inNums' AS label, round(avg(mi), 9) AS mae FROM f UNION ALL SELECT 'outNums', round(avg(mo), 9) FROM f""".lstrip())
def fold_errors(spark, sf_dir):
    """Error of the previous business day as forecast: per fold first, then averaged over the folds."""
    from gateflow.operators import forecast, history
    rows = history.business_day_lags(indexed(dense_flow(spark, sf_dir)), lags=[1])
    gaps = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.abs(F.col(c) - F.col(f"{c}_lag_1")).alias("gap"))
                               for c in ("inNums", "outNums")]))
    scores = (rows.filter(F.col("inNums_lag_1").isNotNull()).select(model.arithmetic_fold(5).alias("fold"), gaps.alias("g"))
              .groupBy("fold", F.col("g.label").alias("label")).agg(F.avg("g.gap").alias("mae")))
    return forecast.mean_over_folds(scores).withColumn("mae", F.round("mae", 9))


@query("masked_labels", with_(DENSE, BUSINESS) + """
SELECT stationID, idx AS businessIndex, slot, CAST(idx - 21 AS INTEGER) AS dayGap,
       CAST(CASE WHEN idx <> 21 THEN inNums END AS DOUBLE) AS inNums,
       CAST(CASE WHEN idx <> 21 THEN outNums END AS DOUBLE) AS outNums, -1 AS payType
FROM flow JOIN business USING (day)""")
def masked_labels(spark, sf_dir):
    rows = business_flow(spark, sf_dir).withColumns({"anchor": F.lit(21), "payType": F.lit(-1)})
    rows = grid.mask_labels(rows, FORECAST_DAY).withColumn("dayGap", grid.day_gap())
    return rows.select("stationID", "businessIndex", "slot", "dayGap", F.col("inNums").cast("double").alias("inNums"),
                       F.col("outNums").cast("double").alias("outNums"), "payType")


@query("day_slices", with_(DENSE) + """
SELECT part, count(*) AS rows, CAST(sum(inNums) AS BIGINT) AS inNums, CAST(sum(outNums) AS BIGINT) AS outNums FROM (
  SELECT CASE WHEN day < DATE '2024-01-29' THEN 'train' WHEN day = DATE '2024-01-29' THEN 'valid' ELSE 'test' END AS part,
         inNums, outNums FROM flow WHERE day <> DATE '2024-01-01') GROUP BY 1""")
def day_slices(spark, sf_dir):
    rows = grid.drop_first_day(stored_flow(spark, sf_dir), FIRST_DAY)
    parts = zip(("train", "valid", "test"), model.day_slices(rows, PREVIOUS_DAY, FORECAST_DAY))
    tagged = [df.withColumn("part", F.lit(name)) for name, df in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("inNums").alias("inNums"), F.sum("outNums").alias("outNums"))


@query("distance_weights", with_(DENSE, BUSINESS) + """
SELECT stationID, idx AS businessIndex, slot, round(power(0.5::DOUBLE, abs(idx - 21) / 5.0::DOUBLE), 9) AS weight
FROM flow JOIN business USING (day) WHERE idx < 21""")
def distance_weights(spark, sf_dir):
    rows = business_flow(spark, sf_dir).filter("businessIndex < 21").withColumn("anchor", F.lit(21))
    return rows.select("stationID", "businessIndex", "slot",
                       F.round(model.distance_weight(half_life=5.0), 9).alias("weight"))


def _total_flow(spark, sf_dir):
    """Total-flow forecast with the weather of the day before and the whole road table."""
    from gateflow.operators import network
    from gateflow.queries.network import network_edges
    from gateflow.sources.dimensions import parse_weather
    # the stand-in for the weather is read off the swipes, so a day may only see the day before
    days = parse_weather(weather_days(spark, sf_dir)).select(F.date_add("day", 1).alias("day"), "tempHigh", "tempLow")
    roads = materialise(network.road_features(materialise(network_edges(spark, sf_dir), "edges")), "roads").na.fill(-1)
    return [total_flow.total_flow_forecast(swipes(spark, sf_dir), FIRST_DAY, PREVIOUS_DAY, FORECAST_DAY,
                                           model.Boosting.preset("total-flow", rounds=20, rate=0.2, depth=4, patience=5), CLOSED,
                                           stations=roads, days=days)]


def _pay_type(spark, sf_dir):
    return [total_flow.pay_type_forecast(swipes(spark, sf_dir), FIRST_DAY, PREVIOUS_DAY, FORECAST_DAY,
                                         model.Boosting(rounds=3, rate=0.3, depth=3, patience=2), CLOSED)]


def _rolling_errors(spark, sf_dir):
    table, names = rolling_origin.feature_table(swipes(spark, sf_dir), FIRST_DAY, FORECAST_DAY, HOLIDAYS, ORIGIN,
                                                dt.date(2024, 1, 26))
    return [rolling_origin.rolling_errors(table, names, [18, 19, 20], model.Boosting(rounds=4, rate=0.3, depth=3, patience=2))]


@query("gbt_rolling_origin")
def gbt_rolling_origin(spark, sf_dir):
    """Errors per fold and target."""
    return one_run(spark, sf_dir, "gbt_rolling_origin", _rolling_errors)[0]


@query("gbt_rolling_origin_facts", """
SELECT label, CAST(d AS INTEGER) AS validDay, CAST(d + 1 AS INTEGER) AS testDay, TRUE AS measured
FROM (SELECT unnest(['inNums', 'outNums']) AS label), (SELECT unnest([18, 19, 20]) AS d)""")
def gbt_rolling_origin_facts(spark, sf_dir):
    """Each target has an error for every validation day, measured on the business day after it."""
    return gbt_rolling_origin(spark, sf_dir).select("label", "validDay", "testDay", (F.col("mae") >= 0).alias("measured"))


def _rolling_forecast(spark, sf_dir):
    """Forecast of the rolling-origin plan: fitted to all days before the forecast day."""
    table, names = rolling_origin.feature_table(swipes(spark, sf_dir), FIRST_DAY, FORECAST_DAY, HOLIDAYS, ORIGIN, FORECAST_DAY)
    return [rolling_origin.final_forecast(table, names, 21, FORECAST_DAY,
                                          model.Boosting(rounds=4, rate=0.3, depth=3, patience=2), CLOSED)]


def _anchor_windows(spark, sf_dir):
    rows = business_flow(spark, sf_dir)
    cells = tf.add_time_fields(indexed(grid.grid(rows, FORECAST_DAY, FORECAST_DAY)))
    return anchor_windows.anchor_forecast(rows, cells, [2, 3, 5, 7], 21, FORECAST_DAY, QUICK, closed=CLOSED)


def _wide_days(spark, sf_dir):
    return wide_days.wide_days_forecast(dense_flow(spark, sf_dir), LABEL_DAYS[:-1], FORECAST_DAY, QUICK, closed=CLOSED)


def _absolute(spark, sf_dir):
    """Absolute loss with the published leaves and row share; fewer rounds, a larger rate and smaller leaves."""
    setting = model.Boosting.preset("absolute-loss", rounds=4, rate=0.5, patience=2, min_rows=20)
    return absolute.absolute_forecast(dense_flow(spark, sf_dir), FIRST_DAY, FORECAST_DAY, setting, 15, CLOSED)


PLANS = {"gbt_forecast": _total_flow, "gbt_paytype": _pay_type, "gbt_rolling_forecast": _rolling_forecast,
         "gbt_anchor_windows": _anchor_windows, "gbt_wide_days": _wide_days, "gbt_absolute": _absolute}


def _register_plan(name: str) -> None:
    @query(name)
    def plan(spark, sf_dir):
        return one_run(spark, sf_dir, name, PLANS[name])[0]


for _name in PLANS:
    _register_plan(_name)
    _register_facts(_name)


@query("gbt_anchor_errors")
def gbt_anchor_errors(spark, sf_dir):
    """Out-of-fold errors per span, label and fold."""
    return one_run(spark, sf_dir, "gbt_anchor_windows", _anchor_windows)[1]


@query("gbt_anchor_folds", """
SELECT span, label, CAST(10 AS BIGINT) AS folds FROM (SELECT unnest([2, 3, 5, 7]) AS span), (SELECT unnest(['inNums', 'outNums']) AS label)""")
def gbt_anchor_folds(spark, sf_dir):
    """Every span and label has the error of every fold."""
    errors = gbt_anchor_errors(spark, sf_dir).filter("mae >= 0")
    return errors.groupBy("span", "label").agg(F.count_distinct("fold").alias("folds"))


@query("gbt_wide_errors")
def gbt_wide_errors(spark, sf_dir):
    """Out-of-fold errors per label and fold."""
    return one_run(spark, sf_dir, "gbt_wide_days", _wide_days)[1]


@query("gbt_absolute_rounds")
def gbt_absolute_rounds(spark, sf_dir):
    """Rounds fitted until the fit stopped itself, best round and error of the own fold, per label and fold."""
    return one_run(spark, sf_dir, "gbt_absolute", _absolute)[1]


_FOLDS = """folds AS (
  SELECT *, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', stationID, strftime(day, '%Y-%m-%d'), slot, '0')), stationID, day, slot) - 1) % 15
            AS INTEGER) AS fold FROM dense WHERE day < DATE '2024-01-30')"""


@query("gbt_absolute_leaves", with_(DENSE, _FOLDS) + """
SELECT label, f AS fold, (SELECT count(*) FROM folds WHERE fold <> f) AS most_rows, (SELECT count(*) FROM folds WHERE fold <> f) AS least_rows,
       CAST(0 AS BIGINT) AS wrong
FROM (SELECT unnest(['inNums', 'outNums']) AS label), (SELECT CAST(unnest(range(15)) AS INTEGER) AS f)""")
def gbt_absolute_leaves(spark, sf_dir):
    """In each round of each fit every row of the other folds is in one leaf, and no leaf's value differs from the median
    of its rows' residuals."""
    return one_run(spark, sf_dir, "gbt_absolute", _absolute)[2]


@query("balanced_folds", with_(DENSE, _FOLDS) + """
SELECT stationID, strftime(folds.day, '%Y-%m-%d') AS day, slot, fold, (SELECT count(*) FROM folds f WHERE f.fold = folds.fold) AS size FROM folds""")
def balanced_folds(spark, sf_dir):
    """Shuffled folds that differ by one row at most, with their sizes."""
    rows = dense_flow(spark, sf_dir).filter(F.col("day") < F.lit(FORECAST_DAY))
    folds = materialise(model.balanced_folds(rows, ["stationID", "day", "slot"], 15), "folds")
    sizes = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("size"))
    return day_text(folds.join(sizes, "fold").select("stationID", "day", "slot", "fold", "size"))


def _importance(spark, sf_dir):
    table = materialise(total_flow.feature_table(swipes(spark, sf_dir), FIRST_DAY, FORECAST_DAY), "features")
    _, models = total_flow.train(table, PREVIOUS_DAY, FORECAST_DAY, FIRST_DAY, QUICK)
    return [model.importance([*models["inNums"], *models["outNums"]])]


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Importance of the total-flow features, averaged over the first fit and the refit."""
    return one_run(spark, sf_dir, "feature_importance", _importance)[0].orderBy(F.desc("importance"), "feature")


_FEATURES = ["stationID", "week", "weekend", "hour", "minute", "daySinceFirst", "inNums", "outNums", "ratio_p", *[f"{c}_p" for c in _CARRIED]]
_CELLS = ", ".join(f"struct_pack(a := '{a}', b := '{b}', correlation := corr({a}, {b}))" for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1:])


@query("feature_table_correlation", f"""
WITH t AS (SELECT {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0) AS {c}' for c in _FEATURES)} FROM ({SQL['total_flow_features']}))
SELECT a, b, round(correlation, 6) AS correlation FROM (SELECT unnest([{_CELLS}], recursive := true) FROM t)
WHERE correlation IS NOT NULL AND NOT isnan(correlation)""")
def feature_table_correlation(spark, sf_dir):
    """Every pair of columns of the whole feature table of the total-flow forecast."""
    from gateflow.operators import selection
    table = materialise(QUERIES["total_flow_features"](spark, sf_dir), "features")
    return selection.correlation_table(table, _FEATURES).withColumn("correlation", F.round("correlation", 6))


@query("feature_importance_facts", "SELECT unnest([" + ", ".join(f"'{c}'" for c in _FEATURES if c not in ("inNums", "outNums"))
       + "]) AS feature, TRUE AS share, 1.0::DOUBLE AS total")
def feature_importance_facts(spark, sf_dir):
    """Every feature has a share, and the shares add up to 1."""
    rows = feature_importance(spark, sf_dir)
    total = F.round(rows.agg(F.sum("importance")).scalar(), 9)
    return rows.select("feature", F.col("importance").between(0, 1).alias("share"), total.alias("total"))


def _selection(spark, sf_dir):
    """Importance of each total-flow feature by shuffled copies on the validation day, and the errors of all and of the kept ones."""
    from gateflow.operators import selection
    table = materialise(total_flow.feature_table(swipes(spark, sf_dir), FIRST_DAY, FORECAST_DAY), "features").na.fill(0)
    fitting, valid, _ = model.day_slices(table.filter(F.col("day") != F.lit(FIRST_DAY)), PREVIOUS_DAY, FORECAST_DAY)
    names = total_flow.feature_names(table)
    whole = model.fit(fitting, names, "inNums", QUICK)
    found, error = selection.permutation_importance(valid, ["stationID", "day", "slot"], names, "inNums",
                                                    lambda df: model.predict(whole, df, "_pred"))
    found = materialise(found, "importance")
    kept = model.select_by_importance(found, 0.0) or names
    again = model.predict(model.fit(fitting, kept, "inNums", QUICK), valid, "_pred").agg(F.avg(F.abs(F.col("inNums") - F.col("_pred")))).first()[0]
    return [found.withColumns({"kept": F.col("feature").isin(kept), "errorOfAll": F.lit(error), "errorOfKept": F.lit(again)})]


@query("feature_selection")
def feature_selection(spark, sf_dir):
    return one_run(spark, sf_dir, "feature_selection", _selection)[0]


@query("feature_selection_facts", "SELECT unnest([" + ", ".join(f"'{c}'" for c in _FEATURES if c not in ("inNums", "outNums"))
       + "]) AS feature, TRUE AS rightlyKept, TRUE AS errorsKnown")
def feature_selection_facts(spark, sf_dir):
    """Every feature has been shuffled, those whose loss costs something are kept, and both errors are there."""
    return feature_selection(spark, sf_dir).select(
        "feature", ((F.col("importance") > 0) == F.col("kept")).alias("rightlyKept"),
        ((F.col("errorOfAll") >= 0) & (F.col("errorOfKept") >= 0)).alias("errorsKnown"))


@query("weighted_fit_facts", with_(FLOW, "days AS (SELECT DISTINCT flow.day, weekday FROM flow)", BUSINESS) + """
SELECT unnest(['ones', 'zeros', 'halved']) AS weights, unnest([count(*), count(*), count(*)]) AS rows,
       unnest([CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)]) AS differing FROM flow JOIN business USING (day) WHERE idx < 21""")
def weighted_fit_facts(spark, sf_dir):
    """Weights of 1 give the unweighted forecast, weights of 0 the one without those rows, equal weights of 1/2 change nothing."""
    from gateflow.operators import staged
    rows = staged.assembled(business_flow(spark, sf_dir).filter("businessIndex < 21"), ["stationID", "slot", "weekday"])
    rows = materialise(rows.withColumns({"one": F.lit(1.0), "half": F.lit(0.5), "recent": F.when(F.col("businessIndex") > 9, 1.0).otherwise(0.0)}), "weighted")
    setting = model.Boosting(rounds=3, rate=0.5, depth=3, rows=1.0)

    def differing(name, left, left_weight, right, right_weight):
        a, b = model.side_by_side([lambda d=d, w=w: staged.fit(d, "inNums", setting, weight=w) for d, w in ((left, left_weight), (right, right_weight))])
        return b.predict(a.predict(rows, "a"), "b").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("differing")).select(
            F.lit(name).alias("weights"), "rows", "differing")

    recent = rows.filter("recent > 0")
    return (differing("ones", rows, "one", rows, None).unionByName(differing("zeros", rows, "recent", recent, None))
            .unionByName(differing("halved", rows, "half", rows, None)))


@query("streaming_slot_flow", with_(SWIPE) + """
SELECT stationID, startTime, inNums, outNums FROM (
  SELECT stationID, time_bucket(INTERVAL 10 MINUTE, time) AS startTime, CAST(sum(status) AS BIGINT) AS inNums,
         CAST(count(*) - sum(status) AS BIGINT) AS outNums FROM swipe GROUP BY 1, 2)
WHERE startTime + INTERVAL 10 MINUTE <= (SELECT date_trunc('millisecond', max(time)) FROM swipe) - INTERVAL 10 MINUTE""")
def streaming_slot_flow(spark, sf_dir):
    """The event file as a stream, run until it is used up; slots still open are not emitted."""
    from gateflow.sources.swipes import swipes_from_events
    from gateflow.streaming import slot_stream
    folder = run_folder(spark, "stream")
    result = slot_stream.slot_flow_stream(swipes_from_events(slot_stream.event_stream(spark, sf_dir)))
    slot_stream.start(result, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/rows")
