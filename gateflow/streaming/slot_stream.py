"""Slot flow on a stream of swipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gateflow.operators.flow import entries, exits

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_batch: int = 1000) -> DataFrame:
    """New event files of a folder as they appear."""
    return (spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def slot_flow_stream(swipes: DataFrame, minutes: int = 10, lateness: str = "10 minutes") -> DataFrame:
    """Entries and exits per station and slot, emitted once the slot can receive no more swipes.

    The state holds open slots only: stations times the few slots the watermark leaves open.
    """
    timed = swipes.filter(F.col("stationID").isNotNull()).withColumn("time", F.col("time").cast("timestamp"))
    return (
        timed.withWatermark("time", lateness)
        .groupBy("stationID", F.window("time", f"{minutes} minutes").alias("_w"))
        .agg(entries().alias("inNums"), exits().alias("outNums"))
        .select("stationID", F.col("_w.start").cast("timestamp_ntz").alias("startTime"), "inNums", "outNums")
    )


def start(result: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the closed slots to parquet files, exactly once across restarts."""
    writer = result.writeStream.format("parquet").outputMode("append").option("path", folder).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
