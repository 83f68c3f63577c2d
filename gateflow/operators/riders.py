"""Per-rider operators: regular riders, activity, trips between stations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateflow.constants import REGULAR_RIDER_SWIPES
from gateflow.operators.flow import with_slot
from gateflow.session import materialise


def regular_flow(swipes: DataFrame, threshold: int = REGULAR_RIDER_SWIPES, excluded_pay_type: int = 3) -> DataFrame:
    """Entries and exits of riders with at least ``threshold`` swipes, per station and slot.

    Swipes are reduced to (rider, station, slot) counts before anything is joined, so the busiest
    rider is as small as the grid.
    """
    kept = with_slot(swipes).filter((F.col("payType") != excluded_pay_type) & F.col("userID").isNotNull())
    counts = materialise(kept.groupBy("userID", "stationID", "day", "slot").agg(
        F.sum("status").alias("_in"), F.count(F.lit(1)).alias("_n")), "riders")
    regulars = counts.groupBy("userID").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= threshold)
    return (counts.join(regulars.select("userID"), "userID", "left_semi").groupBy("stationID", "day", "slot")
            .agg(F.sum("_in").alias("inRegular"), (F.sum("_n") - F.sum("_in")).alias("outRegular")))


def station_activity(swipes: DataFrame, pass_type: int = 3) -> DataFrame:
    """Swipes per station, riders, riders using the pass type, and swipes minus the other riders."""
    per_rider = swipes.groupBy("stationID", "userID").agg(
        F.count(F.lit(1)).alias("_n"), F.max((F.col("payType") == pass_type).cast("int")).alias("_pass"))
    return per_rider.groupBy("stationID").agg(
        F.sum("_n").alias("swipes"), F.count(F.lit(1)).alias("riders"), F.sum("_pass").alias("passRiders"),
    ).withColumn("activity", F.col("swipes") - (F.col("riders") - F.col("passRiders")))


def with_next(events: DataFrame, key: str, columns: Sequence[str], order: Sequence[str] = ("time", "event_id"),
              minutes: int = 1) -> DataFrame:
    """Columns of the same rider's next event as ``next_*``; NULL after the last one, and for events without rider or time.

    A plain window per rider would put a rider with a third of all rows into one task. Here a group is one rider and
    one stretch of ``minutes``. The table is dealt once and stored with each event's place in its stretch; only the last
    events of the stretches then look up the first event of the rider's next stretch.
    """
    first, *_ = order
    names = list(dict.fromkeys([key, *order, *columns]))
    known = F.col(key).isNotNull() & F.col(first).isNotNull()
    minute = F.expr(f"datediff({first}, DATE'1970-01-01') * 1440L + hour({first}) * 60 + minute({first})")
    # events without rider or time have no successor; they go round by hash
    chunk = F.when(known, minute - F.pmod(minute, F.lit(minutes))).otherwise(F.xxhash64(*order))
    w = Window.partitionBy(key, "_chunk").orderBy(*order)
    stored = materialise(events.select(*names).withColumn("_chunk", chunk).withColumns({
        "_next": F.when(known, F.lead(F.struct(*columns)).over(w)), "_opens": known & (F.row_number().over(w) == 1)})
        .withColumn("_closes", known & F.col("_next").isNull()), "next")
    opening = stored.filter("_opens").select(key, "_chunk", F.struct(*columns).alias("_own"))
    follow = opening.select(key, "_chunk", F.lead("_own").over(Window.partitionBy(key).orderBy("_chunk")).alias("_after"))
    closing = stored.filter("_closes").drop("_next").join(follow, [key, "_chunk"], "left").withColumnRenamed("_after", "_next")
    both = stored.filter("NOT _closes").unionByName(closing)
    return both.select(*names, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def trips(swipes: DataFrame, minutes: int = 1) -> DataFrame:
    """An entry directly followed by the same rider's exit: origin, destination, whole minutes."""
    paired = with_next(swipes, "userID", ["status", "stationID", "time"], minutes=minutes)
    seconds = F.timestamp_diff("SECOND", F.col("time"), F.col("next_time"))
    return paired.filter((F.col("status") == 1) & (F.col("next_status") == 0)).select(
        "userID", F.col("stationID").alias("src"), F.col("next_stationID").alias("dst"),
        F.floor(seconds / 60).cast("int").alias("minutes"))


def trip_statistics(trip_rows: DataFrame) -> DataFrame:
    """Count, mean, quartiles and mode of the duration per pair of stations.

    Trips are counted per pair and minute first; the quantiles work on those counts.
    """
    counts = trip_rows.groupBy("src", "dst", "minutes").agg(F.count(F.lit(1)).alias("_n"))
    m, n = F.col("minutes"), F.col("_n")
    return counts.groupBy("src", "dst").agg(
        F.sum(n).alias("trips"), (F.sum(m * n) / F.sum(n)).alias("mean"),
        F.percentile(m, F.lit(0.5), n).alias("median"), F.percentile(m, F.lit(0.25), n).alias("q25"),
        F.percentile(m, F.lit(0.75), n).alias("q75"), F.max_by(m, F.struct(n, -m)).alias("mode"))


def station_role(degree: Column) -> Column:
    """End of a line, ordinary station or transfer station."""
    return F.when(degree <= 1, "start").when(degree == 2, "ordinary").otherwise("transfer")
