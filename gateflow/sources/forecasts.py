"""Feature tables and forecast files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.sources.dimensions import TEMPLATE_SCHEMA, TIME_FORMAT

FORECAST_COLUMNS = ["stationID", "startTime", "endTime", "inNums", "outNums"]


def run_stamp(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now()).strftime("%Y_%m_%d_%H_%M")


def write_features(features: DataFrame, folder: str, by: str | None = "day", files: int = 1) -> None:
    """Feature table between the feature job and the model job, partitioned by day for pruning.

    Rows are dealt by day and a salt first: a day has ``files`` files, however many tasks wrote it.
    """
    if by:
        features = features.repartition(by, F.pmod(F.xxhash64(*features.columns), F.lit(files)))
    writer = features.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(folder)


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def write_forecast(forecast: DataFrame, folder: str, run_id: str) -> None:
    """Forecast CSV in the fixed column order, sorted, in its own run folder."""
    out = forecast.select(*FORECAST_COLUMNS).orderBy("stationID", "startTime")
    out = out.withColumns({c: F.date_format(c, TIME_FORMAT) for c in ("startTime", "endTime")})
    out.write.mode("errorifexists").option("header", True).csv(f"{folder}/run={run_id}")


def read_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Every forecast below a folder in one read, with its run id."""
    return (spark.read.option("header", True).option("timestampNTZFormat", TIME_FORMAT)
            .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).schema(TEMPLATE_SCHEMA).csv(folder)
            .withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), "run=([^/]+)", 1)))
