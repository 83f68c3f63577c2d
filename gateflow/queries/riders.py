"""Per-rider queries. A station is a property of the gate here, so riders move between stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gateflow.operators import riders
from gateflow.queries.flow import swipes
from gateflow.queries.registry import SWIPE, day_text, query, with_
from gateflow.session import materialise


@query("regular_riders", with_(SWIPE) + """,
c AS (SELECT * FROM swipe WHERE payType <> 3),
r AS (SELECT userID FROM c GROUP BY 1 HAVING count(*) >= 50)
SELECT stationID, strftime(c.day, '%Y-%m-%d') AS day, slot, CAST(sum(status) AS BIGINT) AS inRegular,
       CAST(count(*) - sum(status) AS BIGINT) AS outRegular
FROM c WHERE userID IN (SELECT userID FROM r) GROUP BY stationID, c.day, slot""".lstrip())
def regular_riders(spark, sf_dir):
    return day_text(riders.regular_flow(swipes(spark, sf_dir)))


@query("station_activity", """
WITH s AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT CAST(k % 10 AS INTEGER) AS stationID, count(*) AS swipes, count(DISTINCT user_id) AS riders,
       count(DISTINCT user_id) FILTER (k % 4 = 3) AS passRiders,
       count(*) - (count(DISTINCT user_id) - count(DISTINCT user_id) FILTER (k % 4 = 3)) AS activity
FROM s GROUP BY 1""")
def station_activity(spark, sf_dir):
    return riders.station_activity(swipes(spark, sf_dir, station_from="device"))


_TRIPS = """e AS (
  SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS st,
         CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS status FROM events),
n AS (SELECT *, lead(status) OVER w AS ns, lead(st) OVER w AS nst, lead(ts) OVER w AS nt FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
trip AS (SELECT user_id, CAST(st AS INTEGER) AS src, CAST(nst AS INTEGER) AS dst,
                CAST(floor(date_sub('second', ts, nt) / 60) AS INTEGER) AS minutes
         FROM n WHERE status = 1 AND ns = 0)"""


@query("next_swipe", with_(_TRIPS) + """
SELECT event_id, coalesce(nst, -1) AS next_stationID, nt AS next_time FROM n""".replace("coalesce(nst", "coalesce(CAST(nst AS INTEGER)"))
def next_swipe(spark, sf_dir):
    out = riders.with_next(swipes(spark, sf_dir, station_from="device"), "userID", ["stationID", "time"])
    return out.select("event_id", F.coalesce("next_stationID", F.lit(-1)).alias("next_stationID"), "next_time")


@query("od_trips", with_(_TRIPS) + """,
g AS (SELECT src, dst, count(*) AS trips, avg(minutes) AS mean, median(minutes) AS median,
             quantile_cont(minutes, 0.25) AS q25, quantile_cont(minutes, 0.75) AS q75 FROM trip GROUP BY 1, 2),
m AS (SELECT src, dst, first(minutes ORDER BY n DESC, minutes) AS mode
      FROM (SELECT src, dst, minutes, count(*) n FROM trip GROUP BY 1, 2, 3) GROUP BY 1, 2),
deg AS (SELECT st AS src, CASE WHEN st IN (0, 9) THEN 1 ELSE 2 END AS d FROM (SELECT DISTINCT st FROM e))
SELECT g.*, mode, CASE WHEN abs(src - dst) = 1 THEN 1 ELSE 0 END AS connected,
       CASE WHEN d <= 1 THEN 'start' WHEN d = 2 THEN 'ordinary' ELSE 'transfer' END AS role
FROM g JOIN m USING (src, dst) JOIN deg USING (src)""".lstrip())
def od_trips(spark, sf_dir):
    """Trip statistics per pair of stations, with the link between them and the origin's role."""
    from gateflow.operators import network
    sw = swipes(spark, sf_dir, station_from="device")
    out = riders.trip_statistics(riders.trips(sw))
    ids = materialise(sw.select(F.col("stationID").alias("src")).distinct(), "stations")
    edges = ids.select("src", F.explode(F.array(F.col("src") - 1, F.col("src") + 1)).alias("dst")).join(
        ids.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
    roles = network.degrees(edges).select(F.col("stationID").alias("src"),
                                          riders.station_role(F.col("degree")).alias("role"))
    linked = out.join(edges.withColumn("connected", F.lit(1)), ["src", "dst"], "left").na.fill(0, ["connected"])
    return linked.join(roles, "src")
