"""Features from earlier rows of the same series.

Windows are keyed so that a group is bounded by the calendar (days of one station and slot, slots of
one station and day), never by the number of swipes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Wide tables are written as SQL expressions: one parsed text per column instead of a chain of calls.

FLOWS = ("inNums", "outNums")


def business_day_lags(dense: DataFrame, columns: Sequence[str] = FLOWS, lags: Sequence[int] = (1, 2, 3),
                      index: str = "businessIndex") -> DataFrame:
    """Value of the same slot 1, 2, 3 business days earlier, on a dense grid of business days."""
    w = f"(PARTITION BY stationID, slot ORDER BY {index})"
    return dense.withColumns({f"{c}_lag_{k}": F.expr(f"lag(`{c}`, {k}) OVER {w}") for k in lags for c in columns})


def previous_day(rows: DataFrame, columns: Sequence[str] = FLOWS, index: str = "dayIndex",
                 keys: Sequence[str] = ("stationID", "slot"), suffix: str = "_p",
                 first_from_itself: bool = False) -> DataFrame:
    """Columns of the row exactly one day index earlier; NULL where that row does not exist.

    A lag that is kept only when the indices are adjacent gives the self-join's result with one
    shuffle instead of two. ``first_from_itself`` repeats the first day as its own predecessor.
    """
    w = f"(PARTITION BY {', '.join(keys)} ORDER BY {index})"
    first = "WHEN {index} = 1 THEN `{c}` " if first_from_itself else ""
    case = "CASE " + first + "WHEN lag({index}) OVER {w} = {index} - 1 THEN lag(`{c}`) OVER {w} END"
    return rows.withColumns({c + suffix: F.expr(case.format(index=index, c=c, w=w)) for c in columns})


def neighbour_slots(dense: DataFrame, columns: Sequence[str] = FLOWS, order: str = "slot",
                    keys: Sequence[str] = ("stationID", "day")) -> DataFrame:
    """Value one slot before and after, within the same station and day."""
    w = f"(PARTITION BY {', '.join(keys)} ORDER BY {order})"
    out = {}
    for c in columns:
        out[f"{c}_1"] = F.expr(f"lag(`{c}`) OVER {w}")
        out[f"{c}_-1"] = F.expr(f"lead(`{c}`) OVER {w}")
    return dense.withColumns(out)


def last_days_wide(dense: DataFrame, label_days: Sequence, k: int = 5, lookback: int | None = None) -> DataFrame:
    """The k most recent days before each label day as columns ``In1..Ink, out1..outk``.

    ``gap1..gapk`` tell how many days back each of them lies; days without data are skipped, however long the gap.
    ``lookback``, if given, leaves out days further back than that.
    """
    labels = F.array(*[F.lit(d) for d in label_days])
    feeding = F.filter(labels, lambda label: (label > F.col("day")) & (
        F.lit(True) if lookback is None else F.datediff(label, F.col("day")) <= lookback))
    rows = dense.withColumn("labelDay", F.explode(feeding)).withColumn("_gap", F.datediff("labelDay", "day"))
    w = Window.partitionBy("stationID", "slot", "labelDay").orderBy(F.desc("day"))
    ranked = rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    picks = [F.expr(f"max({c}) FILTER (WHERE _rank = {i}) AS {name}{i}") for i in range(1, k + 1)
             for c, name in (("inNums", "In"), ("outNums", "out"), ("_gap", "gap"))]
    return ranked.groupBy("stationID", "slot", "labelDay").agg(*picks)


def rolling_mean(dense: DataFrame, columns: Sequence[str] = FLOWS) -> DataFrame:
    """Mean of a slot and the slot before it, across midnight too; 0 for a station's first slot.

    Each day is its own window group: the last slot of a day is handed to the next day as slot -1.
    """
    carried = (dense.filter(F.col("slot") == 143)
               .withColumn("slot", F.lit(-1)).withColumn("day", F.date_add("day", 1)))
    w = Window.partitionBy("stationID", "day").orderBy("slot").rowsBetween(-1, Window.currentRow)
    return (
        dense.unionByName(carried)
        .withColumns({f"{c}_roll2": F.when(F.count(c).over(w) == 2, F.avg(c).over(w)).otherwise(F.lit(0.0))
                      for c in columns})
        .filter(F.col("slot") >= 0)
    )


def peaks_valleys(dense: DataFrame, column: str = "inNums") -> DataFrame:
    """Slots strictly above (peak) or strictly below (valley) both neighbours."""
    w = Window.partitionBy("stationID", "day").orderBy("slot")
    x, before, after = F.col(column), F.lag(column).over(w), F.lead(column).over(w)
    return (
        dense.withColumn("kind", F.when((x > before) & (x > after), "peak").when((x < before) & (x < after), "valley"))
        .filter(F.col("kind").isNotNull())
    )


def expanding_stats(flow: DataFrame, grains: dict[str, Sequence[str]] | None = None,
                    columns: dict[str, str] | None = None) -> DataFrame:
    """Max, min and mean of all days up to and including the row's own day, per grain.

    Every grain contains station and hour, so one shuffle on those two serves all windows.
    """
    grains = grains or {"h": ["stationID", "hour"], "hm": ["stationID", "hour", "minute"],
                        "wh": ["stationID", "weekday", "hour"], "whm": ["stationID", "weekday", "hour", "minute"]}
    columns = columns or {"in": "inNums", "out": "outNums"}
    common = [k for k in next(iter(grains.values())) if all(k in g for g in grains.values())]
    out = flow.repartition(*common)
    for name, grain in grains.items():
        w = f"(PARTITION BY {', '.join(grain)} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        out = out.withColumns({
            f"{prefix}_{name}_{stat}": F.expr(f"{fn}({c}) OVER {w}")
            for prefix, c in columns.items() for stat, fn in (("max", "max"), ("min", "min"), ("mean", "avg"))})
    return out
