import datetime as dt

from pyspark.sql import functions as F

from gateflow.operators import flow as flow_ops
from gateflow.operators import profile, selection, stats
from tests.conftest import rows

DAY = dt.date(2024, 1, 1)


def test_median_quantile_and_zero_fill(spark):
    src = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 7)], "k INT, v BIGINT")
    target = spark.createDataFrame([(1,), (2,), (3,)], "k INT")
    got = {r.k: r for r in stats.add_stats(target, src, ["k"], "v", ["median", "quantile", "std", "var"], q=0.25).collect()}
    assert (got[1].v_k_median, got[1].v_k_quantile) == (2, 1.5)
    assert (got[2].v_k_std, got[2].v_k_var) == (0, 0)
    assert got[3].v_k_median == 0


def test_given_names(spark):
    src = spark.createDataFrame([(1, 3)], "k INT, v BIGINT")
    assert stats.add_stats(src, src, ["k"], "v", ["max"], ["top"]).columns == ["k", "v", "top"]


def test_tiers_follow_ids_not_positions(make_flow):
    flow = make_flow([(s, DAY, 0, i, i) for s, i in ((53, 100), (55, 600), (56, 1200), (9, 1))])
    got = {r.stationID: (r.tier_in, r.tier_out) for r in stats.station_tiers(flow).collect()}
    assert got == {53: (0, 0), 55: (2, 2), 56: (3, 3), 9: (4, 4)}


def test_night_profile_counts_nonzero_days(make_flow):
    flow = make_flow([(1, dt.date(2024, 1, d), 2, v, 0) for d, v in ((1, 0), (2, 4), (3, 2))])
    assert rows(stats.night_profile(flow)) == [(1, 2, 2, 3.0, 0, 0.0)]


def test_transfer_means(make_flow):
    history = make_flow([(1, DAY, 0, 2, 0), (1, DAY, 1, 4, 0)])
    target = make_flow([(1, DAY, 9, None, None)]).select("stationID", "slot")
    assert stats.transfer_means(target, history, {"m": ("inNums", ["stationID"])}).first().m == 3


def test_quasi_constant_is_strictly_above(spark):
    df = spark.range(100).select(
        F.when(F.col("id") < 91, 1).otherwise(F.col("id")).alias("a"),
        F.when(F.col("id") < 90, 1).otherwise(F.col("id")).alias("b"),
        F.when(F.col("id") < 5, "x").alias("c"),
        F.when(F.col("id") < 95, "same").otherwise(F.col("id").cast("string")).alias("d"),
        F.col("id").cast("double").alias("e"))
    kept, dropped = selection.drop_quasi_constant(df)
    assert sorted(dropped) == ["a", "c", "d"] and kept.columns == ["b", "e"]
    assert {r["column"]: r.topShare for r in selection.dominant_values(df).collect()} == {"a": .91, "c": .95, "d": .95}


def test_profile_and_narrowing(spark):
    df = spark.createDataFrame([(1, 300, 0.5, None), (2, -5, 1.0, 7)], "a BIGINT, b BIGINT, c DOUBLE, d BIGINT")
    assert {r["column"]: (r.type, r.missing) for r in profile.column_profile(df).collect()} == {
        "a": ("tinyint", 0), "b": ("smallint", 0), "c": ("float", 0), "d": ("tinyint", 1)}
    out, filled = profile.narrow(df)
    assert filled == ["d"] and rows(out, "d") == [(6,), (7,)]
    assert dict(out.dtypes) == {"a": "tinyint", "b": "smallint", "c": "float", "d": "tinyint"}


def test_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k INT, v STRING")
    b = spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "k INT, v STRING")
    assert profile.datasets_equal(a, b)
    assert rows(profile.differences(a, b.limit(2).union(b.limit(1))), "k", "surplus") != []


def test_value_counts_keep_nulls(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "v STRING")
    assert {r.value: r.share for r in profile.value_frequencies(df, ["v"]).collect()} == {"a": 1 / 3, None: 2 / 3}
    assert rows(profile.column_stats(df, ["v"]), "topShare", "nunique") == [(2 / 3, 1)]


def test_outliers(make_swipes):
    sw = make_swipes([("2024-01-01 08:00:00", 54, 1, 1, "u", 0), ("2024-01-03 08:00:00", 1, 1, 7, "u", 0)])
    got = profile.outlier_checks(sw, 54, DAY, dt.date(2024, 1, 2)).first()
    assert (got.closedSeen, got.timeOutside, got.statusKnown) == (1, 1, 0)


def test_correlation(spark):
    df = spark.range(50).select(F.col("id").alias("a"), (-F.col("id")).alias("b"), (F.col("id") % 7).alias("c"))
    got = {(r.a, r.b): r.correlation for r in selection.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert abs(got[("a", "b")] + 1) < 1e-12 and len(got) == 3


def test_include_exclude_suffix(spark):
    df = spark.range(1).select("id", F.lit(1).alias("a"))
    assert selection.include(df, ["a", "zz"]).columns == ["a"]
    assert selection.exclude(df, ["a"]).columns == ["id"]
    assert selection.suffix_columns(df, "_p", ["id"]).columns == ["id", "a_p"]


def test_summary(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (4,)], "v INT")
    got = profile.summary(df, ["v"]).first()
    assert (got["count"], got["unique"], got.top, got.freq, got.q50, got.mean) == (4, 3, "2", 2, 2.0, 2.25)


def test_one_station_with_a_third_of_all_rows(make_swipes):
    data = [("2024-01-01 %02d:%02d:00" % (i % 24, i % 60), 0 if i % 3 == 0 else i, i % 50, i % 2, f"u{i % 7}", 0)
            for i in range(3000)]
    sw = make_swipes(data)
    total = flow_ops.slot_flow(sw).agg(F.sum("inNums"), F.sum("outNums")).first()
    assert total[0] + total[1] == 3000
