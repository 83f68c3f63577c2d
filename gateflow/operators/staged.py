"""Boosting one tree at a time: leaf values of its own, a stop inside the fit, row weights.

Every round fits a Spark decision tree to what the rounds before left over and then sets the value of each leaf itself:
the median of the leaf's residuals for the absolute loss (the tree is fitted to their signs), the mean for the squared
loss. The loss of the validation rows is taken after each round and ends the fit once ``patience`` rounds brought no
gain, so no round is fitted that is not looked at. Per round a few numbers and one value per leaf reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateflow.operators.model import Boosting
from gateflow.session import materialise

BINS = 256


@dataclass
class Staged:
    """A fitted chain of trees. ``leaves`` has the value of each leaf of each round, ``losses`` the validation losses."""

    setting: Boosting
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    leaves: list[dict[float, float]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    best: int = 0

    def step(self, k: int, df: DataFrame) -> DataFrame:
        """Leaf of round ``k`` as ``_leaf`` and its value, times the rate, as ``_step``."""
        scored = self.trees[k].transform(df).drop("_tree")
        return scored.withColumn("_step", self.value(k, F.col("_leaf")) * F.lit(self.setting.rate))

    def value(self, k: int, leaf: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in self.leaves[k].items() for x in pair])
        return F.coalesce(known[leaf], F.lit(0.0)) if self.leaves[k] else F.lit(0.0)

    def predict(self, df: DataFrame, name: str, rounds: int | None = None) -> DataFrame:
        """Forecast of rows from ``assembled``: the sum over the best rounds."""
        df = df.withColumn(name, F.lit(0.0))
        for k in range(self.best if rounds is None else rounds):
            df = self.step(k, df).withColumn(name, F.col(name) + F.col("_step")).drop("_leaf", "_step")
        return df


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with all features as one vector, in a column ``_features``; missing features count as 0."""
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(df.na.fill(0, list(features)))


def weighted_medians(df: DataFrame, group: str, value: str, weight: str, bins: int = BINS) -> dict:
    """Exact weighted medians of few, arbitrarily large groups, as {group: median}.

    The median is the value at which half of the weight is passed; if a value ends exactly at the half, the mean of it
    and the next one. Both are enclosed by aggregations over equal bins: each tells the bin in which the weight passes
    the half, and the next one divides that bin, until it holds one value. So a group is never put in order anywhere,
    and only the weights of the bins reach the driver.
    """
    g, x, w = F.col(group), F.col(value), F.col(weight)
    start = df.groupBy(g).agg(F.min(x), F.max(x), F.sum(w)).collect()
    half = {r[0]: r[3] / 2 for r in start}
    # (group, which): [least, largest, weight before]; 0 reaches the half, 1 passes it
    cells = {(r[0], k): [r[1], r[2], 0.0] for r in start for k in (0, 1)}
    while True:
        wide = {}
        for (name, _), (low, high, before) in cells.items():
            if low < high and (low, high, before) not in wide.setdefault(name, []):
                wide[name].append((low, high, before))
        if not any(wide.values()):
            return {name: (cells[name, 0][0] + cells[name, 1][0]) / 2 for name in half}
        rows = None
        for k in (0, 1):  # a group's cells are one or two, and they do not overlap
            of = {name: found[k] for name, found in wide.items() if len(found) > k}
            if of:
                low, high = (F.create_map(*[F.lit(v) for name, c in of.items() for v in (name, c[at])])[g] for at in (0, 1))
                one = df.filter((x >= low) & (x <= high)).select(
                    g.alias("g"), F.lit(k).alias("k"), x.alias("x"), w.alias("w"),
                    F.least(F.floor((x - low) / (high - low) * F.lit(bins)), F.lit(bins - 1)).alias("bin"))
                rows = one if rows is None else rows.unionByName(one)
        held = {}
        for r in rows.groupBy("g", "k", "bin").agg(F.sum("w"), F.min("x"), F.max("x")).collect():
            held.setdefault((r[0], r[1]), []).append(tuple(r)[2:])
        for (name, which), cell in cells.items():
            if cell[0] < cell[1]:
                upto = cell[2]
                for _, held_weight, low, high in sorted(held[name, wide[name].index(tuple(cell))]):
                    upto += held_weight
                    if upto > half[name] or (which == 0 and upto == half[name]):
                        cells[name, which] = [low, high, upto - held_weight]
                        break
                else:  # the half is the end of the group: nothing passes it
                    cells[name, which] = [high, high, upto]


def fit(rows: DataFrame, label: str, setting: Boosting, valid: str | None = None, weight: str | None = None,
        key: Sequence[str] = ("stationID", "day", "slot")) -> Staged:
    """Fit rows from ``assembled``; those with a true ``valid`` column only serve to stop.

    Rows of weight 0 or without a label take no part. The share ``setting.rows`` of a round is drawn by the hash of
    ``key`` and the round, the same on every run.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    held = F.col(valid) if valid else F.lit(False)
    state = materialise(rows.filter(F.col(label).isNotNull()).select(
        *key, "_features", F.col(label).cast("double").alias("_label"), w.alias("_w"), held.alias("_valid"), F.lit(0.0).alias("_f"))
        .filter("_w > 0"), "staged")
    absolute = setting.loss == "absolute"
    chain, best = Staged(setting), math.inf
    gap = F.col("_label") - F.col("_f")
    error = F.abs(gap) if absolute else gap * gap
    if state.filter("NOT _valid").isEmpty():
        return chain
    for k in range(setting.rounds):
        fitting = state.filter("NOT _valid").select(*key, "_features", "_w", gap.alias("_gap"))
        drawn = F.pmod(F.xxhash64(*key, F.lit(setting.seed), F.lit(k)), F.lit(1000)) < F.lit(int(setting.rows * 1000))
        tree = DecisionTreeRegressor(featuresCol="_features", labelCol="_target", predictionCol="_tree", leafCol="_leaf", weightCol="_w",
                                     maxDepth=setting.depth, maxBins=setting.bins, minInstancesPerNode=setting.min_rows, seed=setting.seed)
        target = F.signum("_gap") if absolute else F.col("_gap")
        chain.trees.append(tree.fit(fitting.filter(drawn).select("_features", "_w", target.alias("_target"))))
        leaves = chain.trees[k].transform(fitting).select("_leaf", "_gap", "_w")
        chain.leaves.append(weighted_medians(leaves, "_leaf", "_gap", "_w") if absolute else {
            r[0]: r[1] for r in leaves.groupBy("_leaf").agg(F.sum(F.col("_gap") * F.col("_w")) / F.sum("_w")).collect()})
        # stored each round: every round's plan has one tree, and none reads an older state
        state = materialise(chain.step(k, state).withColumn("_f", F.col("_f") + F.col("_step")).drop("_leaf", "_step"), "staged")
        if valid is None:
            chain.best = k + 1
            continue
        loss = state.filter("_valid").agg(F.sum(error * F.col("_w")) / F.sum("_w")).first()[0]
        chain.losses.append(loss)
        if loss is None or loss < best:
            best, chain.best = loss if loss is not None else best, k + 1
        elif k + 1 - chain.best >= setting.patience:
            break
    return chain


def fit_refit(train: DataFrame, everything: DataFrame, label: str, setting: Boosting, valid: str, **options) -> tuple[Staged, Staged]:
    """Stop on the validation rows, then fit all rows for as many rounds as were best."""
    first = fit(train, label, setting, valid, **options)
    return first, fit(everything, label, replace(setting, rounds=max(1, first.best)), **options)


def leaf_check(chain: Staged, rows: DataFrame, label: str) -> DataFrame:
    """(round, leaf, rows, value, median) of every leaf over the fitted rows, medians by Spark's own function."""
    out, df = None, rows.withColumn("_f", F.lit(0.0))
    for k in range(len(chain.trees)):
        df = chain.step(k, df)
        one = df.groupBy(F.lit(k + 1).alias("round"), F.col("_leaf").alias("leaf")).agg(
            F.count(F.lit(1)).alias("rows"), F.median(F.col(label) - F.col("_f")).alias("median"))
        one = one.withColumn("value", chain.value(k, F.col("leaf")))
        out = one if out is None else out.unionByName(one)
        df = df.withColumn("_f", F.col("_f") + F.col("_step")).drop("_leaf", "_step")
    return out
