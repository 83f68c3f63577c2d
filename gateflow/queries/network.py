"""Network, weather and dimension queries.

The network is read off the swipes: stations that follow each other on a line are connected.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gateflow.functions import numeric as num
from gateflow.operators import flow, network
from gateflow.queries.flow import swipes
from gateflow.queries.registry import FLOW, SWIPE, day_text, query, with_
from gateflow.session import materialise
from gateflow.sources.dimensions import parse_weather

STATIONS = 81

EDGES = f"""stops AS (SELECT DISTINCT CAST(user_id % {STATIONS} AS INTEGER) AS s,
                 CAST(user_id % {STATIONS} % 3 AS INTEGER) AS line FROM events),
hops AS (SELECT s AS src, lead(s) OVER (PARTITION BY line ORDER BY s) AS dst FROM stops),
rings AS (SELECT min(s) AS src, max(s) AS dst FROM stops GROUP BY line HAVING min(s) < max(s)),
oneway AS (SELECT * FROM hops WHERE dst IS NOT NULL UNION SELECT src, src + 1 FROM rings WHERE src < 2
           UNION SELECT 0, max(s) FROM stops),
edges AS (SELECT src, dst FROM oneway UNION SELECT dst, src FROM oneway)"""


def network_edges(spark, sf_dir):
    """Neighbouring stations of each line, two changes between lines and one long link; symmetric."""
    stops = materialise(swipes(spark, sf_dir, stations=STATIONS).select("stationID", "lineID").distinct(), "stops")
    hops = stops.select(F.col("stationID").alias("src"), F.lead("stationID").over(
        Window.partitionBy("lineID").orderBy("stationID")).alias("dst")).filter("dst IS NOT NULL")
    ends = stops.groupBy("lineID").agg(F.min("stationID").alias("src"), F.max("stationID").alias("last"))
    changes = ends.filter("src < last AND src < 2").select("src", (F.col("src") + 1).alias("dst"))
    link = stops.agg(F.lit(0).alias("src"), F.max("stationID").alias("dst"))
    oneway = hops.unionByName(changes).unionByName(link)
    return oneway.unionByName(oneway.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


@query("neighbour_list", with_(EDGES) + """
SELECT src AS stationID, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) AS INTEGER) AS rank, dst AS neighbour FROM edges""")
def neighbour_list(spark, sf_dir):
    return network.neighbour_ranks(network_edges(spark, sf_dir))


@query("station_degree", with_(EDGES) + "SELECT dst AS stationID, count(*) AS degree FROM edges GROUP BY dst")
def station_degree(spark, sf_dir):
    return network.degrees(network_edges(spark, sf_dir))


@query("graph_checks", with_(EDGES) + """
SELECT count(*) AS pairs, count(*) / ((SELECT count(*) FROM stops) * (SELECT count(*) FROM stops))::DOUBLE AS share,
       CASE WHEN EXISTS (SELECT src, dst FROM edges EXCEPT SELECT dst, src FROM edges) THEN 0 ELSE 1 END AS symmetric
FROM edges""")
def graph_checks(spark, sf_dir):
    return network.graph_checks(network_edges(spark, sf_dir))


def _svd_sql(cells: str, row: str, column: str, names, start: str, rounds: int = 10) -> str:
    """The iteration as a chain of subqueries over ``cells`` (row, column)."""
    parts = [f"v0 AS MATERIALIZED (SELECT {column}, 1.0::DOUBLE AS x, ({start})::DOUBLE AS y FROM (SELECT DISTINCT {column} FROM {cells}))"]
    for k in range(rounds):
        parts += [
            f"u{k} AS MATERIALIZED (SELECT {row}, sum(x) AS x, sum(y) AS y FROM {cells} JOIN v{k} USING ({column}) GROUP BY 1)",
            f"t{k} AS MATERIALIZED (SELECT {column}, sum(x) AS x, sum(y) AS y FROM {cells} JOIN u{k} USING ({row}) GROUP BY 1)",
            f"g{k} AS MATERIALIZED (SELECT sum(x * x) AS xx, sum(x * y) AS xy FROM t{k})",
            f"o{k} AS MATERIALIZED (SELECT {column}, x / sqrt(xx) AS x, y - xy / xx * x AS y FROM t{k}, g{k})",
            f"n{k} AS MATERIALIZED (SELECT sum(y * y) AS yy FROM o{k})",
            f"v{k + 1} AS MATERIALIZED (SELECT {column}, x, y / sqrt(yy) AS y FROM o{k}, n{k})"]
    parts += [f"signs AS (SELECT CASE WHEN sum(x) < 0 THEN -1 ELSE 1 END AS sx, "
              f"CASE WHEN sum(y * ({start})) < 0 THEN -1 ELSE 1 END AS sy FROM v{rounds})",
              f"f AS (SELECT {row}, round(sum(x), 6) AS a, round(sum(y), 6) AS b FROM {cells} JOIN v{rounds} USING ({column}) GROUP BY 1)"]
    return ", ".join(parts) + f" SELECT {{row}}, a * sx + 0.0 AS {names[0]}, b * sy + 0.0 AS {names[1]} FROM f, signs"


@query("graph_svd", with_(EDGES, "cells AS (SELECT DISTINCT src AS stationID, dst FROM edges)", _svd_sql(
    "cells", "stationID", "dst", ["mapSVD1", "mapSVD2"], network.ROAD_START).format(row="stationID")))
def graph_svd(spark, sf_dir):
    edges = network_edges(spark, sf_dir).withColumnRenamed("src", "stationID")
    out = network.svd_features(edges, "stationID", "dst", ["mapSVD1", "mapSVD2"], network.ROAD_START)
    return out.withColumns({c: F.round(c, 6) for c in ("mapSVD1", "mapSVD2")})


def _nmf_sql(iterations: int = 10) -> str:
    first = "(SELECT {0}, (1 + 0.5 * ({0} % 3))::DOUBLE AS x, (1 + 0.25 * ({0} % 5))::DOUBLE AS y FROM (SELECT DISTINCT {0} FROM edges))"
    parts = [f"w0 AS MATERIALIZED {first.format('src')}", f"h0 AS MATERIALIZED {first.format('dst')}"]

    def update(new, own, other, by, onto):
        parts.extend([
            f"g_{new} AS MATERIALIZED (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM {other})",
            f"p_{new} AS MATERIALIZED (SELECT {onto}, sum(x) AS px, sum(y) AS py FROM edges JOIN {other} USING ({by}) GROUP BY 1)",
            f"{new} AS MATERIALIZED (SELECT {onto}, x * px / (x * xx + y * xy) AS x, y * py / (x * xy + y * yy) AS y "
            f"FROM {own} JOIN p_{new} USING ({onto}), g_{new})"])
    for k in range(iterations):
        update(f"h{k + 1}", f"h{k}", f"w{k}", "src", "dst")
        update(f"w{k + 1}", f"w{k}", f"h{k + 1}", "dst", "src")
    return ", ".join(parts) + f" SELECT src AS stationID, round(x, 6) AS mapNMF1, round(y, 6) AS mapNMF2 FROM w{iterations}"


@query("graph_nmf", with_(EDGES, _nmf_sql()))
def graph_nmf(spark, sf_dir):
    out = network.nmf_features(network_edges(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mapNMF1", "mapNMF2")})


# Weather stand-in: most frequent event type of the day, value range as temperature, size of the day as wind.
WEATHER = """types AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
weather AS (
  SELECT day, weat, CAST(hi AS VARCHAR) || '/' || CAST(lo AS VARCHAR) AS temp, hi, lo,
         CASE WHEN total % 2 = 0 THEN 'even' ELSE 'odd' END || '/calm' AS wind
  FROM (SELECT day, first(event_type ORDER BY n DESC, event_type) AS weat, CAST(sum(n) AS BIGINT) AS total
        FROM types GROUP BY day)
  JOIN (SELECT CAST(ts AS DATE) AS day, CAST(floor(max(value)) AS INTEGER) AS hi,
               CAST(floor(min(value)) AS INTEGER) AS lo FROM events GROUP BY 1) USING (day))"""


def weather_days(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    per_type = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    # Most frequent type, first name on ties: smallest of (-n, name).
    top = F.min(F.struct(-F.col("n"), F.col("event_type")))["event_type"]
    temp = F.concat_ws("/", F.floor(F.max("hi")).cast("int"), F.floor(F.min("lo")).cast("int"))
    return per_type.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        top.alias("weat"), temp.alias("temp"),
        F.concat(F.when(F.sum("n") % 2 == 0, "even").otherwise("odd"), F.lit("/calm")).alias("wind"))


@query("weather_parts", with_(WEATHER) + """
SELECT strftime(day, '%Y-%m-%d') AS day, weat, CAST(hi AS DOUBLE) AS tempHigh, CAST(lo AS DOUBLE) AS tempLow,
       split_part(wind, '/', 1) AS windDay, split_part(wind, '/', 2) AS windNight,
       round((1.818::DOUBLE * lo + 18.18::DOUBLE) * (0.88::DOUBLE + 0.002::DOUBLE * 0.6::DOUBLE)
             + CASE WHEN lo <> 45 THEN (lo - 32.0::DOUBLE) / (45.0::DOUBLE - lo) END
             - 3.2::DOUBLE * 2 + 18.2::DOUBLE, 6) AS comfort
FROM weather""")
def weather_parts(spark, sf_dir):
    parts = parse_weather(weather_days(spark, sf_dir))
    return day_text(parts.select("day", "weat", "tempHigh", "tempLow", "windDay", "windNight",
                                 F.round(num.comfort_index(F.col("tempLow")), 6).alias("comfort")))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("weather_onehot", with_(WEATHER) + "SELECT strftime(day, '%Y-%m-%d') AS day, "
       + ", ".join(f"CASE WHEN weat = '{t}' THEN 1 ELSE 0 END AS weat_{t}" for t in _TYPES)
       + ", CASE WHEN wind = 'even/calm' THEN 1 ELSE 0 END AS wind_even,"
         " CASE WHEN wind = 'odd/calm' THEN 1 ELSE 0 END AS wind_odd FROM weather")
def weather_onehot(spark, sf_dir):
    days = parse_weather(weather_days(spark, sf_dir))
    coded = network.one_hot(network.one_hot(days, "weat", _TYPES), "wind", ["even/calm", "odd/calm"])
    return day_text(coded.select("day", *[f"weat_{t}" for t in _TYPES], F.col("`wind_even/calm`").alias("wind_even"),
                                 F.col("`wind_odd/calm`").alias("wind_odd")))


@query("weather_svd", with_(WEATHER, "cells AS (SELECT day, 'weat=' || weat AS cell FROM weather UNION SELECT day, 'wind=' || wind FROM weather)",
                            _svd_sql("cells", "day", "cell", ["weatsvd1", "weatsvd2"], network.WEATHER_START).format(
                                row="strftime(day, '%Y-%m-%d') AS day")))
def weather_svd(spark, sf_dir):
    out = day_text(network.weather_features(parse_weather(weather_days(spark, sf_dir))))
    return out.withColumns({c: F.round(c, 6) for c in ("weatsvd1", "weatsvd2")})


@query("line_onehot", with_(SWIPE) + """
SELECT DISTINCT stationID, lineID, CASE WHEN lineID = 'A' THEN 1 ELSE 0 END AS lineID_A,
       CASE WHEN lineID = 'B' THEN 1 ELSE 0 END AS lineID_B, CASE WHEN lineID = 'C' THEN 1 ELSE 0 END AS lineID_C
FROM swipe""")
def line_onehot(spark, sf_dir):
    return network.one_hot(swipes(spark, sf_dir).select("stationID", "lineID").distinct(), "lineID")


@query("dim_enrich", with_(FLOW, EDGES, WEATHER) + """,
road AS (SELECT dst AS stationID, count(*) AS degree, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS neighbours FROM edges GROUP BY 1)
SELECT stationID, strftime(f.day, '%Y-%m-%d') AS day, slot, inNums, outNums, coalesce(degree, -1) AS degree,
       coalesce(neighbours, '') AS neighbours, weat, temp
FROM flow f LEFT JOIN road USING (stationID) LEFT JOIN weather w ON w.day = f.day""".lstrip())
def dim_enrich(spark, sf_dir):
    edges = materialise(network_edges(spark, sf_dir), "edges")
    road = network.degrees(edges).join(network.neighbour_lists(edges), "stationID").withColumn(
        "neighbours", F.array_join("neighbours", ","))
    days = parse_weather(weather_days(spark, sf_dir)).select("day", "weat", "temp")
    return day_text(network.enrich(flow.slot_flow(swipes(spark, sf_dir)), road, days).na.fill(-1).na.fill("", ["neighbours"]))
