"""Raw swipes to flow tables.

Every aggregation here combines on the map side first, so a station, device or user that holds a
large share of the rows reaches the shuffle as a handful of partial rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateflow.constants import SLOT_MINUTES
from gateflow.functions.timefields import minute_of, slot_in_day, slot_start, weekday
from gateflow.session import materialise


def entries() -> Column:
    return F.sum("status")


def exits() -> Column:
    return F.count("status") - F.sum("status")


def with_slot(swipes: DataFrame, minutes: int = SLOT_MINUTES) -> DataFrame:
    """Day and slot keys for every swipe with a known station and time."""
    return swipes.filter(F.col("stationID").isNotNull() & F.col("time").isNotNull()).withColumns({
        "day": F.to_date("time"),
        "slot": slot_in_day(F.col("time"), minutes),
    })


def with_grain_fields(swipes: DataFrame) -> DataFrame:
    """Day, slot, weekday, hour and minute: the fields all grains are built from."""
    return with_slot(swipes).withColumns({
        "weekday": weekday(F.col("day")),
        "hour": F.hour("time"),
        "minute": minute_of(F.col("slot")),
    })


def slot_flow(swipes: DataFrame, extra_keys: Sequence[str] = (), minutes: int = SLOT_MINUTES) -> DataFrame:
    """Entries and exits per station and slot; ``extra_keys`` (ticket type) refine the key."""
    return (
        with_slot(swipes, minutes)
        .groupBy("stationID", "day", "slot", *extra_keys)
        .agg(entries().alias("inNums"), exits().alias("outNums"))
    )


def status_pivot(swipes: DataFrame) -> DataFrame:
    """Status values as columns, counted per station and slot, empty cells zero."""
    return (
        with_slot(swipes).groupBy("stationID", "day", "slot")
        .pivot("status", [0, 1]).agg(F.count(F.lit(1)))
        .na.fill(0, ["0", "1"]).withColumnsRenamed({"0": "outNums", "1": "inNums"})
    )


def windowed_counts(swipes: DataFrame, closed: bool = False, minutes: int = SLOT_MINUTES) -> DataFrame:
    """Entries and exits per window. With ``closed`` windows a swipe exactly on a boundary also
    belongs to the window that ends there; each swipe names its windows, so no range join."""
    slotted = with_slot(swipes, minutes)
    start = slot_start(F.col("day"), F.col("slot"), minutes)
    starts = F.array(start)
    if closed:
        before = start - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
        starts = F.when(F.col("time") == start, F.array(before, start)).otherwise(starts)
    return (
        slotted.select("stationID", "status", F.explode(starts).alias("startTime"))
        .groupBy("stationID", "startTime").agg(entries().alias("inNums"), exits().alias("outNums"))
    )


def distinct_counts(swipes: DataFrame, column: str, grains: dict[str, Sequence[str]],
                    approximate: bool = False) -> DataFrame:
    """Distinct values of ``column`` at several grains, one row per grain and group.

    Rows are reduced to distinct (finest key, value) first; only that reduced table is expanded to
    the grouping sets. ``approximate`` keeps sketches instead where an estimate is enough.
    """
    keys = list(dict.fromkeys(k for grain in grains.values() for k in grain))
    counter = F.approx_count_distinct if approximate else F.count_distinct
    codes = {
        name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in grain)
        for name, grain in grains.items()
    }
    label = F.lit(None).cast("string")
    for name, code in codes.items():
        label = F.when(F.col("_set") == code, F.lit(name)).otherwise(label)
    return (
        swipes.select(*keys, column).distinct()
        .groupingSets([list(g) for g in grains.values()], *keys)
        .agg(counter(column).alias("n"), F.grouping_id().alias("_set"))
        .select(label.alias("grain"), *keys, "n")
    )


def device_bitmaps(swipes: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Exact sets of whole numbers as bitmaps: (keys, bucket, bits) at the finest grain; NULL is in no set.

    A bitmap has a fixed size and covers 32,768 numbers; others lie in further buckets. Rows are combined to distinct
    (keys, value) before the shuffle, and the sets are built where they meet.
    """
    value = F.col(column).cast("long")
    rows = swipes.select(*keys, value.alias("_v")).distinct()
    return rows.groupBy(*keys, F.bitmap_bucket_number("_v").alias("bucket")).agg(
        F.bitmap_construct_agg(F.when(F.col("_v").isNotNull(), F.bitmap_bit_position("_v"))).alias("bits"))


def distinct_by_bitmaps(sets: DataFrame, grains: dict[str, Sequence[str]]) -> DataFrame:
    """Distinct values at several grains from stored finest sets, which are OR-ed upwards: one row per grain and group.

    Unlike counts, sets of any days or slots can be merged later. One shuffle of bitmaps, combined on the map side.
    """
    keys = list(dict.fromkeys(k for grain in grains.values() for k in grain))
    kinds = dict(sets.dtypes)
    groups = F.explode(F.array(*[F.struct(F.lit(name).alias("grain"), *[
        (F.col(k) if k in grain else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for name, grain in grains.items()]))
    merged = (sets.select(groups.alias("g"), "bucket", "bits").groupBy("g", "bucket")
              .agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")))
    return merged.groupBy("g").agg(F.sum("n").alias("n")).select("g.*", "n")


def add_distinct_counts(flow: DataFrame, swipes: DataFrame, column: str,
                        grains: dict[str, Sequence[str]]) -> DataFrame:
    """Distinct counts joined back to the flow rows, one column per grain.

    All grains come from one pass over the swipes; the joins read that much smaller table.
    """
    counts = materialise(distinct_counts(swipes, column, grains), "distinct")
    for name, grain in grains.items():
        own = counts.filter(F.col("grain") == name).select(*grain, F.col("n").alias(name))
        flow = flow.join(own, list(grain), "left")
    return flow


def top_values(swipes: DataFrame, columns: Sequence[str], grain: Sequence[str]) -> DataFrame:
    """Largest value and most frequent value (smallest on ties) of integer columns per group.

    The columns are stacked, so one scan and one shuffle of counts serve all of them.
    """
    return _tops(value_counts_by(swipes, columns, grain), columns, grain)


def _tops(counts: DataFrame, columns: Sequence[str], grain: Sequence[str]) -> DataFrame:
    out = []
    for c in columns:
        own = F.when(F.col("column") == c, F.col("value"))
        weight = F.when(F.col("column") == c, F.struct(F.col("n"), -F.col("value")))
        out += [F.max(own).alias(f"{c}_max"), F.max_by(own, weight).alias(f"{c}_mode")]
    return counts.groupBy(*grain).agg(*out)


def top_of_counts(counts: DataFrame, columns: Sequence[str], grain: Sequence[str]) -> DataFrame:
    """The same from stored value counts (keys, column, value, n) of a finer grain, which are added up."""
    return _tops(counts.groupBy(*grain, "column", "value").agg(F.sum("n").alias("n")), columns, grain)


def value_counts_by(swipes: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, column, value, n) of whole-number columns, one scan; NULL is no value."""
    stacked = swipes.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("p"))
    return stacked.filter("p.value IS NOT NULL").groupBy(*keys, "p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def largest_n(df: DataFrame, grain: Sequence[str], column: str, n: int) -> DataFrame:
    """The n largest values per group with their rank; equal values keep their multiplicity.

    Values are counted before ranking, so a group contributes its distinct values, not its rows.
    """
    from pyspark.sql import Window

    counts = df.groupBy(*grain, column).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*grain).orderBy(F.desc(column))
    # n values need at most n distinct ones: the limit is applied in each task before the shuffle
    counts = counts.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        counts.withColumn("_before", before).filter(F.col("_before") < n)
        .withColumn("rank", F.explode(F.sequence(F.col("_before") + 1,
                                                 F.least(F.col("_before") + F.col("_n"), F.lit(n)))))
        .select(*grain, column, F.col("rank").cast("int").alias("rank"))
    )


def device_load(swipes: DataFrame, keys: Sequence[str] = ("stationID", "day", "hour")) -> DataFrame:
    """Spread of entries and exits over the devices of a group."""
    return _spread(swipes.groupBy(*keys, "deviceID").agg(entries().alias("_in"), exits().alias("_out")), keys)


def device_load_of_counts(counts: DataFrame, keys: Sequence[str] = ("stationID", "day", "hour")) -> DataFrame:
    """The same from a flow table kept per device."""
    return _spread(counts.groupBy(*keys, "deviceID").agg(
        F.sum("inNums").alias("_in"), F.sum("outNums").alias("_out")), keys)


def _spread(per_device: DataFrame, keys: Sequence[str]) -> DataFrame:
    return per_device.groupBy(*keys).agg(*[
        F.expr(f"{fn}(_{side}) AS {side}DID_h_{name}")
        for side in ("in", "out") for name, fn in (("max", "max"), ("min", "min"), ("mean", "avg"))
    ])


def resample(swipes: DataFrame, minutes: int = 30) -> DataFrame:
    """Rows, entries and the busiest line (first name on ties) per wider window."""
    per_line = with_slot(swipes, minutes).groupBy("day", "slot", "lineID").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("status").alias("_in"))
    top = F.min(F.struct(-F.col("_n"), F.col("lineID")))["lineID"]
    return per_line.groupBy(slot_start(F.col("day"), F.col("slot"), minutes).alias("startTime")).agg(
        F.sum("_n").alias("rows"), F.sum("_in").alias("entries"), top.alias("busiestLine"))


def busiest_window_line(swipes: DataFrame, minutes: int = 30) -> DataFrame:
    """The single most frequent (window, line) pair."""
    return (
        with_slot(swipes, minutes).groupBy("day", "slot", "lineID").agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "day", "slot", "lineID").limit(1)
        .select(slot_start(F.col("day"), F.col("slot"), minutes).alias("startTime"), "lineID", "rows")
    )
