"""Expanding statistics from a stored state that one new day at a time updates.

The state holds mergeable partials (largest, least, sum, number) per grain and group over all days so far, one version
per day. A step reads the version before it and the rows of its own day, and writes its version; swipes of older days
are never read again, and a late file only means steps from its day on. A version has as many rows as there are groups,
however many days went into it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAINS = {"h": ["stationID", "hour"], "hm": ["stationID", "hour", "minute"],
          "wh": ["stationID", "weekday", "hour"], "whm": ["stationID", "weekday", "hour", "minute"]}
COLUMNS = {"in": "inNums", "out": "outNums"}


def row_partials(rows: DataFrame, grains: dict[str, Sequence[str]] = GRAINS, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """(grain, keys, partials) of each row for itself; a key that is not part of a grain is NULL."""
    keys = list(dict.fromkeys(k for grain in grains.values() for k in grain))
    kinds = dict(rows.dtypes)
    groups = F.array(*[F.struct(F.lit(name).alias("grain"), *[
        (F.col(k) if k in grain else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for name, grain in grains.items()])
    parts = [e for p, c in columns.items() for e in (
        *[F.col(c).alias(f"{p}_{s}") for s in ("max", "min", "sum")], F.col(c).isNotNull().cast("long").alias(f"{p}_n"))]
    return rows.select(F.explode(groups).alias("g"), *columns.values()).select("g.*", *parts)


def merge(*states: DataFrame, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """All partials as one state; one shuffle, combined on the map side."""
    keys = [c for c in states[0].columns if c.rsplit("_", 1)[0] not in columns]
    aggs = [f(f"{p}_{s}").alias(f"{p}_{s}") for p in columns for s, f in (("max", F.max), ("min", F.min), ("sum", F.sum), ("n", F.sum))]
    return reduce(DataFrame.unionByName, states).groupBy(*keys).agg(*aggs)


def day_partials(rows: DataFrame, grains: dict[str, Sequence[str]] = GRAINS, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """(grain, keys, partials) of some rows."""
    return merge(row_partials(rows, grains, columns), columns=columns)


def version(folder: str, day: dt.date) -> str:
    return f"{folder}/day={day:%Y-%m-%d}"


def step(spark: SparkSession, folder: str, previous: dt.date | None, day: dt.date, rows: DataFrame,
         grains: dict[str, Sequence[str]] = GRAINS, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """The state after ``day``: the version of ``previous`` merged with the rows of the day alone."""
    own = row_partials(rows, grains, columns)
    if previous is None:
        return merge(own, columns=columns)
    return merge(spark.read.schema(merge(own, columns=columns).schema).parquet(version(folder, previous)), own, columns=columns)


def advance(spark: SparkSession, folder: str, previous: dt.date | None, day: dt.date, rows: DataFrame, **options) -> None:
    """Write the version of ``day``; a step that is repeated replaces its own version only."""
    step(spark, folder, previous, day, rows, **options).write.mode("overwrite").parquet(version(folder, day))


def attach(rows: DataFrame, state: DataFrame, grains: dict[str, Sequence[str]] = GRAINS, columns: dict[str, str] = COLUMNS,
           extra: Sequence[str] = ()) -> DataFrame:
    """Rows with the largest, least and mean value of each grain; ``extra`` keys (the day) tell versions apart."""
    for name, grain in grains.items():
        shown = [e for p in columns for e in (F.col(f"{p}_max").alias(f"{p}_{name}_max"), F.col(f"{p}_min").alias(f"{p}_{name}_min"),
                                              (F.col(f"{p}_sum") / F.nullif(F.col(f"{p}_n"), F.lit(0))).alias(f"{p}_{name}_mean"))]
        rows = rows.join(state.filter(F.col("grain") == name).select(*extra, *grain, *shown), [*extra, *grain], "left")
    return rows
