import random

import numpy as np
from pyspark.sql import functions as F

from gateflow.operators import network, riders
from gateflow.sources import dimensions
from tests.conftest import rows


def path_edges(spark, n=6):
    pairs = [(i, i + 1) for i in range(n - 1)] + [(0, n - 1), (1, 4)]
    return spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src INT, dst INT")


def test_neighbours_degree_and_checks(spark):
    edges = path_edges(spark)
    got = {r.stationID: (r.map00, r.map01, r.map02, r.map03) for r in network.neighbours(edges).withColumn("map03", F.lit(None)).collect()}
    assert got[0] == (1, 5, None, None) and got[1] == (0, 2, 4, None)
    assert dict(rows(network.degrees(edges)))[4] == 3
    assert network.graph_checks(edges).first().symmetric == 1
    assert network.graph_checks(edges.filter("NOT (src = 0 AND dst = 1)")).first().symmetric == 0


def test_hub_keeps_all_neighbours(spark):
    hub = spark.range(1, 8).select(F.lit(0).alias("src"), F.col("id").cast("int").alias("dst"))
    assert rows(network.neighbours(hub)) == [(0, 1, 2, 3, 4, 5, 6, 7)]
    assert network.neighbour_ranks(hub).count() == 7 and network.neighbour_lists(hub).first().neighbours == [*range(1, 8)]


def test_one_hot_of_many_categories(spark):
    many = spark.range(1001).select(F.format_string("c%04d", "id").alias("c"))
    assert len(network.one_hot(many, "c").columns) == 1002


def matrix(edges, n=6):
    a = np.zeros((n, n))
    for r in edges.collect():
        a[r[0], r[1]] = 1
    return a


def test_svd_equals_numpy(spark):
    edges = path_edges(spark).filter("src <> 3 OR dst <> 4")
    got = network.svd_features(edges, "src", "dst", ["s1", "s2"], network.ROAD_START, rounds=60).orderBy("src").collect()
    u, s, _ = np.linalg.svd(matrix(edges))
    for k, c in enumerate(("s1", "s2")):
        mine, ref = np.array([r[c] for r in got]), u[:, k] * s[k]
        assert min(np.abs(mine - ref).max(), np.abs(mine + ref).max()) < 1e-4


def test_nmf_error_is_close_to_the_best(spark):
    edges = path_edges(spark)
    got = network.nmf_features(edges, iterations=30).orderBy("stationID").collect()
    w = np.array([[r.mapNMF1, r.mapNMF2] for r in got])
    a = matrix(edges)
    assert (w >= 0).all()
    h = np.linalg.lstsq(w, a, rcond=None)[0]
    u, s, v = np.linalg.svd(a)
    best = np.linalg.norm(a - (u[:, :2] * s[:2]) @ v[:2])
    assert np.linalg.norm(a - w @ h) < 1.35 * best + 1e-9


def test_weather_parts_and_features(spark):
    raw = spark.createDataFrame([("2019年01月01日", "cloudy/overcast", "4/2", "north/calm"),
                                 ("2019年01月02日", "rain/rain", "4/1", "calm/calm"),
                                 ("2019年01月03日", "rain/rain", "x/1", "north/calm")], dimensions.WEATHER_SCHEMA)
    parts = dimensions.parse_weather(raw)
    first = parts.orderBy("day").first()
    assert (str(first.day), first.weatDay, first.tempHigh, first.tempLow, first.windNight) == (
        "2019-01-01", "cloudy", 4.0, 2.0, "calm")
    assert parts.filter("tempHigh IS NULL").count() == 1
    assert network.weather_features(parts).count() == 3
    coded = network.one_hot(parts, "weatDay")
    assert rows(coded, "weatDay_cloudy", "weatDay_rain") == [(0, 1), (0, 1), (1, 0)]


def events(spark, data):
    return spark.createDataFrame(data, "event_id INT, t STRING, userID STRING, stationID INT, status INT, payType INT") \
        .withColumn("time", F.to_timestamp_ntz("t"))


def test_next_event_equals_brute_force_with_a_hot_rider(spark):
    random.seed(3)
    data = []
    for i in range(600):
        rider = "hot" if i % 3 == 0 else f"u{random.randint(0, 20)}"
        minute = random.randint(0, 3 * 1440)
        data.append((i, "2024-01-%02d %02d:%02d:00" % (1 + minute // 1440, minute % 1440 // 60, minute % 60), rider,
                     random.randint(0, 4), random.randint(0, 1), 0))
    expected = {}
    for rider in {d[2] for d in data}:
        own = sorted((d[1], d[0], d[3]) for d in data if d[2] == rider)
        for a, b in zip(own, own[1:] + [None]):
            expected[a[1]] = b and b[2]
    df = events(spark, data)
    data += [(900, "2024-01-01 00:00:00", None, 1, 1, 0), (901, "2024-01-01 00:00:00", None, 1, 1, 0), (902, None, "hot", 1, 1, 0)]
    expected |= {900: None, 901: None, 902: None}  # kept, without a successor
    df = events(spark, data)
    for minutes in (1, 60, 1440):
        got = riders.with_next(df, "userID", ["stationID"], minutes=minutes)
        assert {r.event_id: r.next_stationID for r in got.select("event_id", "next_stationID").collect()} == expected


def test_trips(spark):
    df = events(spark, [(1, "2024-01-01 08:00:00", "u", 1, 1, 0), (2, "2024-01-01 08:20:30", "u", 2, 0, 0),
                        (3, "2024-01-01 09:00:00", "u", 2, 1, 0), (4, "2024-01-01 23:50:00", "v", 1, 1, 0),
                        (5, "2024-01-02 00:10:00", "v", 2, 0, 0)])
    got = riders.trips(df)
    assert rows(got, "userID", "src", "dst", "minutes") == [("u", 1, 2, 20), ("v", 1, 2, 20)]
    one = riders.trip_statistics(got).first()
    assert (one.trips, one["mean"], one["median"], one["mode"]) == (2, 20, 20, 20)


def test_regular_riders(spark):
    data = [(i, "2024-01-01 08:%02d:00" % i, "often", 1, i % 2, 0) for i in range(4)]
    data += [(10, "2024-01-01 08:00:00", "rare", 1, 1, 0)] + [
        (20 + i, "2024-01-01 08:00:00", "pass", 1, 1, 3) for i in range(5)]
    got = riders.regular_flow(events(spark, data), threshold=4)
    assert rows(got, "inRegular", "outRegular") == [(2, 2)]


def test_activity_and_roles(spark):
    data = [(i, "2024-01-01 08:00:00", u, 1, 1, p) for i, (u, p) in enumerate([("a", 0), ("a", 3), ("b", 1), ("c", 3)])]
    assert rows(riders.station_activity(events(spark, data))) == [(1, 4, 3, 2, 3)]
    df = spark.createDataFrame([(1,), (2,), (3,)], "d INT")
    assert [r[0] for r in df.select(riders.station_role(F.col("d"))).collect()] == ["start", "ordinary", "transfer"]
