"""Dimension files: adjacency matrix, weather, holiday flags and the forecast template."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPLATE_SCHEMA = T.StructType([
    T.StructField("stationID", T.IntegerType()),
    T.StructField("startTime", T.TimestampNTZType()),
    T.StructField("endTime", T.TimestampNTZType()),
    T.StructField("inNums", T.DoubleType()),
    T.StructField("outNums", T.DoubleType()),
])
WEATHER_SCHEMA = "day STRING, weat STRING, temp STRING, wind STRING"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """0/1 matrix with station ids in the first column and in the header, as directed edges.

    The ids come from the file itself, never from row positions.
    """
    matrix = spark.read.option("header", True).csv(path)
    first, *stations = matrix.columns
    return (
        matrix.unpivot(first, stations, "dst", "adj").filter(F.col("adj").cast("int") == 1)
        .select(F.col(first).cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    )


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Weather by day; the four columns are named by position because the header is not ASCII."""
    return parse_weather(spark.read.option("header", True).schema(WEATHER_SCHEMA)
                         .option("enforceSchema", True).csv(path))


def parse_weather(weather: DataFrame) -> DataFrame:
    """Dates and the slash-packed day / night parts."""
    temp, weat, wind = (F.split(F.col(c), "/") for c in ("temp", "weat", "wind"))
    day = F.regexp_replace("day", "[^0-9]+", "-")
    return weather.select(
        F.to_date(F.regexp_extract(day, r"(\d+-\d+-\d+)", 1)).alias("day"), "weat", "temp", "wind",
        F.get(weat, F.lit(0)).alias("weatDay"), F.get(weat, F.lit(1)).alias("weatNight"),
        F.get(temp, F.lit(0)).try_cast("double").alias("tempHigh"),
        F.get(temp, F.lit(1)).try_cast("double").alias("tempLow"),
        F.get(wind, F.lit(0)).alias("windDay"), F.get(wind, F.lit(1)).alias("windNight"))


def read_holiday_flags(spark: SparkSession, path: str, first: dt.date) -> DataFrame:
    """Holiday flags numbered from zero, turned into real dates."""
    flags = spark.read.option("header", True).schema("day INT, holi INT").csv(path)
    return flags.select(F.date_add(F.lit(first), F.col("day")).alias("day"), "holi")


def read_template(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", True).option("timestampNTZFormat", TIME_FORMAT)
            .schema(TEMPLATE_SCHEMA).csv(path))
