"""Grouped statistics and how they are joined back to detail rows.

No join here carries a broadcast hint: the size of a statistics table follows the number of
stations, so the optimiser decides from the measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateflow.constants import (NIGHT_IN_FROM, NIGHT_IN_UNTIL, NIGHT_OUT_UNTIL, TIER_BOUNDS_IN, TIER_BOUNDS_OUT,
                                TIER_OVERRIDES)
from gateflow.session import materialise


STATS = {
    "count": "count({c})", "nunique": "count(DISTINCT {c})", "mean": "avg({c})", "std": "stddev_samp({c})",
    "median": "median({c})", "max": "max({c})", "min": "min({c})", "sum": "sum({c})", "var": "var_samp({c})",
    "quantile": "percentile({c}, {q})",
}


def _stat(name: str, column: str, q: float, alias: str) -> Column:
    return F.expr(STATS[name].format(c=f"`{column}`", q=q)).alias(alias)


def group_stats(df: DataFrame, grain: Sequence[str], names: dict[str, tuple[str, str]], q: float = 0.5) -> DataFrame:
    """One aggregation per grain; ``names`` maps an output column to (value column, statistic)."""
    return df.groupBy(*grain).agg(*[_stat(s, v, q, out) for out, (v, s) in names.items()])


def feature_name(value: str, grain: Sequence[str], stat: str) -> str:
    return f"{value}_{'_'.join(grain)}_{stat}"


def add_stats(df: DataFrame, source: DataFrame, grain: Sequence[str], value: str, stats: Sequence[str],
              names: Sequence[str] | None = None, q: float = 0.5, fill: bool = True) -> DataFrame:
    """Statistics of ``value`` in ``source`` joined to ``df``; groups without value or with too few rows get 0."""
    names = names or [feature_name(value, grain, s) for s in stats]
    known = source
    for k in grain:
        known = known.filter(F.col(k).isNotNull())
    table = group_stats(known, grain, {n: (value, s) for n, s in zip(names, stats)}, q)
    out = df.join(table, list(grain), "left")
    return out.na.fill(0, list(names)) if fill else out


# How a statistic is put together from partial sums, counts and extremes.
ROLL_UP = {"max": "max(`{c}_max`)", "min": "min(`{c}_min`)", "sum": "sum(`{c}_sum`)",
           "mean": "sum(`{c}_sum`) / sum(`{c}_n`)"}


def family_partials(source: DataFrame, family: dict[str, Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """Sum, count, maximum and minimum at the finest key all grains of a family share."""
    keys = list(dict.fromkeys(k for grain in family.values() for k in grain))
    return source.groupBy(*keys).agg(*[
        F.expr(f"{fn}(`{c}`) AS `{c}_{name}`") for c in columns
        for fn, name in (("sum", "sum"), ("count", "n"), ("max", "max"), ("min", "min"))])


def add_group_family(df: DataFrame, source: DataFrame, family: dict[str, Sequence[str]],
                     columns: Sequence[str] = ("inNums", "outNums"),
                     stats: Sequence[str] = ("max", "min", "mean", "sum")) -> DataFrame:
    """Statistics of several columns at several grains, joined to ``df``.

    The source is read once for partial results, which are stored; every grain is rolled up from them.
    """
    partials = materialise(family_partials(source, family, columns), "partials")
    for tag, grain in family.items():
        rolled = partials.groupBy(*grain).agg(*[
            F.expr(ROLL_UP[s].format(c=c)).alias(f"{c}_{tag}_{s}") for c in columns for s in stats])
        df = df.join(rolled, list(grain), "left")
    return df


TIERS = {"tier_in": ("inNums", "max", TIER_BOUNDS_IN), "tier_out": ("outNums", "max", TIER_BOUNDS_OUT)}
TIERS_MEAN_OUT = {**TIERS, "tier_out": ("outNums", "mean", TIER_BOUNDS_OUT)}


def station_tiers(flow: DataFrame, tiers: dict[str, tuple[str, str, Sequence[float]]] = TIERS,
                  overrides: dict[int, int] = TIER_OVERRIDES) -> DataFrame:
    """Tiers 0-3 of a station, keyed by station id, all of them in one pass.

    ``tiers`` maps an output column to (flow column, statistic per day, bounds); the statistic is
    averaged over the days before it meets the bounds.
    """
    daily = flow.groupBy("stationID", "day").agg(
        *[_stat(per_day, c, 0.5, name) for name, (c, per_day, _) in tiers.items()])
    level = daily.groupBy("stationID").agg(*[F.avg(name).alias(name) for name in tiers])
    out = {}
    for name, (_, _, bounds) in tiers.items():
        tier = F.lit(0)
        for i, bound in enumerate(bounds, start=1):
            tier = F.when(F.col(name) > bound, F.lit(i)).otherwise(tier)
        for station, fixed in overrides.items():
            tier = F.when(F.col("stationID") == station, F.lit(fixed)).otherwise(tier)
        out[name] = tier.cast("int")
    return level.withColumns(out)


def add_station_tiers(df: DataFrame, flow: DataFrame, tiers: dict = TIERS) -> DataFrame:
    return df.join(station_tiers(flow, tiers), "stationID", "left")


def night_in(minute: Column) -> Column:
    return (minute >= NIGHT_IN_FROM) | (minute <= NIGHT_IN_UNTIL)


def night_out(minute: Column) -> Column:
    return minute <= NIGHT_OUT_UNTIL


def night_profile(flow: DataFrame) -> DataFrame:
    """Days with flow and mean flow per station and night slot, entries and exits in one pass."""
    minute = F.col("slot") * 10
    i = F.when(night_in(minute) & (F.col("inNums") != 0), F.col("inNums"))
    o = F.when(night_out(minute) & (F.col("outNums") != 0), F.col("outNums"))
    return (
        flow.filter(night_in(minute) | night_out(minute)).groupBy("stationID", "slot")
        .agg(F.count(i).alias("days_in"), F.avg(i).alias("mean_in"),
             F.count(o).alias("days_out"), F.avg(o).alias("mean_out"))
        .filter((F.col("days_in") > 0) | (F.col("days_out") > 0))
        .na.fill(0.0, ["mean_in", "mean_out"])
    )


def transfer_means(target: DataFrame, history: DataFrame, features: dict[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Mean of a history column at its grain, brought to the target rows. Columns that share a grain
    are averaged together."""
    by_grain: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for name, (column, grain) in features.items():
        by_grain.setdefault(tuple(grain), []).append((name, column))
    for grain, wanted in by_grain.items():
        means = history.groupBy(*grain).agg(*[F.avg(c).alias(n) for n, c in wanted])
        target = target.join(means, list(grain), "left")
    return target
