"""Round trips through the readers and writers: files made from the swipes, written, read back and compared."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gateflow.functions import timefields as tf
from gateflow.operators import grid, selection
from gateflow.queries.flow import stored_flow, swipes
from gateflow.queries.network import EDGES, WEATHER, network_edges, weather_days
from gateflow.queries.registry import DENSE, FLOW, FORECAST_DAY, SWIPE, day_text, query, with_
from gateflow.session import materialise, run_folder
from gateflow.sources import dimensions, forecasts

STAMP = dt.datetime(2024, 1, 31, 8, 30)


@query("template_file", with_(DENSE) + """
SELECT stationID, TIMESTAMP '2024-01-30' + to_minutes(CAST(slot * 10 AS BIGINT)) AS startTime,
       TIMESTAMP '2024-01-30' + to_minutes(CAST(slot * 10 + 10 AS BIGINT)) AS endTime, 0.0::DOUBLE AS inNums, 0.0::DOUBLE AS outNums
FROM cells WHERE day = DATE '2024-01-30'""")
def template_file(spark, sf_dir):
    folder = run_folder(spark, "template")
    rows = grid.template(stored_flow(spark, sf_dir), FORECAST_DAY)
    rows.select("stationID", *[F.date_format(c, dimensions.TIME_FORMAT).alias(c) for c in ("startTime", "endTime")],
                F.lit(0.0).alias("inNums"), F.lit(0.0).alias("outNums")).write.option("header", True).csv(folder)
    return dimensions.read_template(spark, folder)


@query("adjacency_file", with_(EDGES) + "SELECT src, dst FROM edges")
def adjacency_file(spark, sf_dir):
    """The matrix with ids in its header and first column, as a file and back to edges."""
    edges, folder = materialise(network_edges(spark, sf_dir), "edges"), run_folder(spark, "adjacency")
    matrix = edges.groupBy("src").pivot("dst").agg(F.lit(1)).na.fill(0)
    matrix.write.option("header", True).csv(folder)  # a row per station, each file with the header
    return dimensions.read_adjacency(spark, folder)


@query("weather_file", with_(WEATHER) + """
SELECT strftime(day, '%Y-%m-%d') AS day, weat, temp, wind, CAST(hi AS DOUBLE) AS tempHigh, CAST(lo AS DOUBLE) AS tempLow FROM weather""")
def weather_file(spark, sf_dir):
    folder = run_folder(spark, "weather")
    weather_days(spark, sf_dir).select("day", "weat", "temp", "wind").write.option("header", True).csv(folder)
    return day_text(dimensions.read_weather(spark, folder).select("day", "weat", "temp", "wind", "tempHigh", "tempLow"))


@query("feature_files", with_(FLOW) + """
SELECT strftime(flow.day, '%Y-%m-%d') AS day, count(*) AS rows, CAST(sum(inNums) AS BIGINT) AS inNums, CAST(1 AS BIGINT) AS files
FROM flow WHERE day >= DATE '2024-01-20' GROUP BY flow.day""")
def feature_files(spark, sf_dir):
    """The flow as a feature table: one file per day, of which only the days asked for are read."""
    folder = run_folder(spark, "features")
    forecasts.write_features(stored_flow(spark, sf_dir), folder)
    rows = forecasts.read_features(spark, folder).filter(F.col("day") >= F.lit(dt.date(2024, 1, 20)))
    return day_text(rows.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.sum("inNums").alias("inNums"),
                                            F.count_distinct("_metadata.file_path").alias("files")))


@query("stamped_forecast", with_(DENSE) + """
SELECT stationID, TIMESTAMP '2024-01-30' + to_minutes(CAST(slot * 10 AS BIGINT)) AS startTime, CAST(inNums AS DOUBLE) AS inNums,
       CAST(outNums AS DOUBLE) AS outNums, '2024_01_31_08_30' AS run
FROM dense WHERE day = DATE '2024-01-30'""")
def stamped_forecast(spark, sf_dir):
    """A forecast written in the fixed column order under the stamp of its run, and read with it."""
    rows, folder = stored_flow(spark, sf_dir), run_folder(spark, "forecasts")
    cells = grid.template(rows, FORECAST_DAY).join(rows, grid.KEY, "left").na.fill(0, ["inNums", "outNums"])
    forecasts.write_forecast(cells, folder, forecasts.run_stamp(STAMP))
    return forecasts.read_forecasts(spark, folder).select("stationID", "startTime", "inNums", "outNums", "run")


@query("parsed_times", with_(SWIPE) + "SELECT event_id, date_trunc('second', time) AS time FROM swipe")
def parsed_times(spark, sf_dir):
    """Times written as text and read again with the format of the source files; chosen columns only."""
    rows = swipes(spark, sf_dir).withColumn("time", tf.parse_time(F.date_format("time", "yyyy-MM-dd HH:mm:ss")))
    return selection.include(rows, ["event_id", "time"])
