"""Swipe events: CSV files, partitioned tables and any event table mapped onto the same columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SWIPE_SCHEMA = T.StructType([
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("lineID", T.StringType()),
    T.StructField("stationID", T.IntegerType()),
    T.StructField("deviceID", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("userID", T.StringType()),
    T.StructField("payType", T.IntegerType()),
])


def date_in_name(path: Column) -> Column:
    """The ``yyyy-MM-dd`` date embedded in a file or folder name."""
    return F.to_date(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[^/]*(/[^/]*)?$", 1))


def read_swipe_files(spark: SparkSession, folder: str, first: dt.date | None = None,
                     last: dt.date | None = None, skip: Iterable[dt.date] = ()) -> DataFrame:
    """All daily CSV files of a folder in one scan, with the date taken from the file name.

    The date conditions refer to file metadata only, so Spark drops the files before reading them.
    """
    df = (
        spark.read.schema(SWIPE_SCHEMA)
        .option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(folder)
        .select("*", date_in_name(F.col("_metadata.file_path")).alias("fileDate"),
                F.col("_metadata.file_name").alias("fileName"))
    )
    if first is not None:
        df = df.filter(F.col("fileDate") >= F.lit(first))
    if last is not None:
        df = df.filter(F.col("fileDate") <= F.lit(last))
    skipped = list(skip)
    return df.filter(~F.col("fileDate").isin(skipped)) if skipped else df


def rows_per_file(swipes: DataFrame) -> DataFrame:
    return swipes.groupBy("fileDate").agg(F.count(F.lit(1)).alias("rows"))


def write_swipe_files(swipes: DataFrame, folder: str, rows_per_task: int = 2_000_000) -> None:
    """One folder of CSV files per day; the day stays in the path for pruning.

    Rows are counted per day first: a day gets as many files as it has shares of ``rows_per_task`` rows, so neither a
    day with very many swipes is written by one task nor a small one by many.
    """
    rows = swipes.select([f.name for f in SWIPE_SCHEMA]).withColumn("record", F.date_format("time", "yyyy-MM-dd"))
    shares = rows.groupBy("record").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_task)).alias("shares"))
    known = rows.alias("r").join(F.broadcast(shares).alias("s"), F.expr("r.record <=> s.record")).select("r.*", "shares")
    (
        known.repartition("record", F.pmod(F.xxhash64("userID", "time"), F.col("shares"))).drop("shares")
        .withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
        .write.mode("errorifexists").partitionBy("record").option("header", True).csv(folder)
    )


def swipes_from_events(events: DataFrame, stations: int = 10, station_from: str = "user") -> DataFrame:
    """Map an event table onto the swipe columns.

    ``station_from`` picks what a station is: a property of the rider ("user") or of the gate
    ("device"); only the latter lets a rider move between stations.
    """
    device = "cast(get_json_object(props, '$.k') as int)"
    station = f"cast({'user_id' if station_from == 'user' else device} % {int(stations)} as int)"
    return events.selectExpr(
        "event_id",
        "ts AS time",
        f"element_at(array('A', 'B', 'C'), {station} % 3 + 1) AS lineID",
        f"{station} AS stationID",
        f"{device} AS deviceID",
        "cast(event_type IN ('view', 'click') as int) AS status",
        "cast(user_id as string) AS userID",
        f"{device} % 4 AS payType",
        "value",
    )


def read_event_swipes(spark: SparkSession, sf_dir: str, stations: int = 10, station_from: str = "user") -> DataFrame:
    return swipes_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), stations, station_from)
