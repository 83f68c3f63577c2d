"""Trailing-window statistics relative to anchor days, and the training sets built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateflow.constants import TRAILING_WINDOWS, TRAILING_WINDOWS_BY_SPAN

from gateflow.session import materialise

GRAINS = {
    "s": ["stationID"],
    "s_h": ["stationID", "hour"],
    "s_h_m": ["stationID", "hour", "minute"],
    "s_w_h": ["stationID", "weekday", "hour"],
    "s_w_h_m": ["stationID", "weekday", "hour", "minute"],
}

STATS = ("mean", "std", "median", "max", "min", "var")

# Which statistics each grain carries.
DEFAULT_SPEC = {"s": list(STATS), "s_h": ["mean"], "s_h_m": ["mean"], "s_w_h": list(STATS),
                "s_w_h_m": ["mean", "median", "max", "min"]}
SLIP_SPEC = {"s_h_m": ["mean", "median", "max"], "s_w_h": ["mean", "median", "max"],
             "s_w_h_m": ["mean", "median", "max", "min"]}


def day_partials(flow: DataFrame, grain: Sequence[str], columns: Sequence[str], index: str, counted: bool) -> DataFrame:
    """What a group's day adds to any window, one row per group and day, in a form that can be merged.

    Per column: number, sum, sum of squares, least and largest value, and with ``counted`` each value with its count
    (for exact medians). Sums of whole numbers are kept in 38 digits, so merging them loses nothing.
    """
    whole = {c for c in columns if isinstance(flow.schema[c].dataType, T.IntegralType)}
    keys = [*grain, index]
    aggs = []
    for c in columns:
        x = f"cast({c} AS decimal(18, 0))" if c in whole else f"cast({c} AS double)"
        aggs += [F.expr(f"count({c}) AS _n_{c}"), F.expr(f"sum({x}) AS _s_{c}"), F.expr(f"sum({x} * {x}) AS _q_{c}"),
                 F.expr(f"min({c}) AS _lo_{c}"), F.expr(f"max({c}) AS _hi_{c}")]
    out = flow.groupBy(*keys).agg(*aggs)
    if counted:
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
        counts = (flow.select(*keys, values.alias("x")).filter("x.v IS NOT NULL").groupBy(*keys, "x.c", "x.v")
                  .agg(F.count(F.lit(1)).alias("n")))
        lists = counts.groupBy(*keys).agg(*[F.expr(f"collect_list(struct(v, n)) FILTER (WHERE c = '{c}') AS _values_{c}") for c in columns])
        out = out.join(lists, keys, "left")
    return out


def _median(values: str, n: str) -> str:
    """Median of counted values: the two middle ranks are found while the counts are added up in order of the values."""
    return (f"aggregate(array_sort({values}), named_struct('seen', 0L, 'lo', cast(NULL AS double), 'hi', cast(NULL AS double)), "
            f"(a, x) -> named_struct('seen', a.seen + x.n, 'lo', IF(a.lo IS NULL AND a.seen + x.n > ({n} - 1) div 2, x.v, a.lo), "
            f"'hi', IF(a.hi IS NULL AND a.seen + x.n > {n} div 2, x.v, a.hi)), a -> (a.lo + a.hi) / 2)")


def trailing_stats(flow: DataFrame, anchors: Sequence[int], grain: Sequence[str], name: str, windows: Sequence[int],
                   stats: Sequence[str], columns: Sequence[str] = ("inNums", "outNums"),
                   index: str = "businessIndex") -> DataFrame:
    """All windows and statistics of one grain: (anchor, grain, columns); groups without history in a window get 0.

    Day partials are merged over the N days before each anchor by range windows. An anchor enters as one marker row per
    group, in which the windows are read off; the history is neither repeated per anchor nor per window. A window group
    holds a group's days and anchors, which the calendar bounds.
    """
    wanted = [c for c in columns]
    partials = day_partials(flow, grain, wanted, index, "median" in stats)
    marks = (partials.select(*grain).distinct()
             .select(*grain, F.explode(F.array(*[F.lit(int(a)) for a in sorted(set(anchors))])).alias(index), F.lit(True).alias("_mark")))
    rows = partials.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    merged, out = {}, []
    for n in windows:
        w = f"OVER (PARTITION BY {', '.join(grain)} ORDER BY {index} RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        for c in wanted:
            merged[f"_n_{c}_{n}"] = f"sum(_n_{c}) {w}"
            for fn, part, needs in (("sum", "s", {"mean", "std", "var"}), ("sum", "q", {"std", "var"}), ("min", "lo", {"min"}), ("max", "hi", {"max"})):
                if needs & set(stats):
                    merged[f"_{part}_{c}_{n}"] = f"{fn}(_{part}_{c}) {w}"
            if "median" in stats:
                merged[f"_values_{c}_{n}"] = f"flatten(collect_list(_values_{c}) {w})"
            k, s, q = (f"_{part}_{c}_{n}" for part in ("n", "s", "q"))
            # (n * sum of squares - square of the sum) / (n * (n - 1)); whole numbers are exact up to the division
            spread = f"greatest(cast({k} * {q} - {s} * {s} AS double), 0D) / (cast({k} AS double) * ({k} - 1))"
            forms = {"mean": f"cast({s} AS double) / nullif({k}, 0)", "var": f"CASE WHEN {k} > 1 THEN {spread} END",
                     "std": f"CASE WHEN {k} > 1 THEN sqrt({spread}) END", "min": f"_lo_{c}_{n}", "max": f"_hi_{c}_{n}",
                     "median": _median(f"_values_{c}_{n}", k)}
            out += [f"coalesce({forms[stat]}, 0) AS {c}_{stat}_{name}_{n}" for stat in stats]
    rows = rows.select(*grain, index, "_mark", *[F.expr(e).alias(c) for c, e in merged.items()]).filter("_mark")
    return rows.selectExpr(f"{index} AS anchor", *grain, *out)


def add_trailing_stats(labels: DataFrame, flow: DataFrame, anchors: Sequence[int],
                       windows: Sequence[int] = TRAILING_WINDOWS, spec: dict[str, Sequence[str]] | None = None,
                       first_index: int = 1, index: str = "businessIndex",
                       columns: Sequence[str] = ("inNums", "outNums")) -> DataFrame:
    """Join trailing statistics onto label rows that carry their ``anchor``.

    A group without history gets 0; a window longer than the history there is gives NULL. Every grain holds the
    station, so one shuffle of the history by station serves all grains; a station has as many rows as its calendar.
    """
    history = materialise(flow.filter(F.col(index) < max(anchors)).select(
        "stationID", "weekday", "hour", "minute", index, *columns), "trailing")  # read once per grain
    guarded = {}
    for name, stats in (spec or DEFAULT_SPEC).items():
        grain = GRAINS[name]
        table = trailing_stats(history.repartition("stationID"), anchors, grain, name, windows, stats, columns, index)
        labels = labels.join(table, ["anchor", *grain], "left")
        for n in windows:
            guarded.update({c: f"CASE WHEN anchor - {n} >= {first_index} THEN coalesce({c}, 0) END"
                            for c in table.columns if c.endswith(f"_{name}_{n}")})
    return labels.withColumns({c: F.expr(e) for c, e in guarded.items()})


def anchors_before(end: int, span: int, first: int = 2, cap: int | None = None) -> list[int]:
    """Anchor days ``end - span * k``, most recent first, as long as one day of history remains."""
    steps = range(1, (end - first) // span + 1)
    found = [end - span * k for k in steps]
    return found[:cap] if cap is not None else found


def with_anchor(flow: DataFrame, end: int, span: int, anchors: Sequence[int],
                index: str = "businessIndex") -> DataFrame:
    """Label rows before ``end`` with the anchor their span starts at; rows without one are left out."""
    steps = F.ceil((F.lit(end) - F.col(index)) / F.lit(span))
    anchor = (F.lit(end) - steps * F.lit(span)).cast("int")
    return flow.filter((F.col(index) < end) & (F.col(index) >= min(anchors))).withColumn("anchor", anchor)


def anchor_training_set(flow: DataFrame, span: int, end: int, first: int = 2, cap: int | None = None,
                        **options) -> DataFrame:
    """Label rows of all anchors before ``end`` with their trailing statistics."""
    anchors = anchors_before(end, span, first, cap)
    return add_trailing_stats(with_anchor(flow, end, span, anchors), flow, anchors, **options)


def slip_sets(flow: DataFrame, span: int, valid_index: int, test_index: int, cap: int | None = None,
              **options) -> DataFrame:
    """Train, train-all, validation and test rows, told apart by ``part``; ``cap`` keeps that many recent anchors only."""
    train = anchors_before(valid_index, span, cap=cap)
    train_all = anchors_before(test_index, span, cap=cap)

    def one_day(day: int) -> DataFrame:
        return flow.filter(F.col("businessIndex") == day).withColumn("anchor", F.lit(day))

    labels = (
        with_anchor(flow, valid_index, span, train).withColumn("part", F.lit("train"))
        .unionByName(with_anchor(flow, test_index, span, train_all).withColumn("part", F.lit("train_all")))
        .unionByName(one_day(valid_index).withColumn("part", F.lit("valid")))
        .unionByName(one_day(test_index).withColumn("part", F.lit("test")))
    )
    anchors = sorted({*train, *train_all, valid_index, test_index})
    options = {"windows": TRAILING_WINDOWS_BY_SPAN[span], "spec": SLIP_SPEC, **options}
    return add_trailing_stats(labels, flow, anchors, **options)
