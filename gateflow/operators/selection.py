"""Feature selection: near-constant columns, correlation, importance."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.constants import QUASI_CONSTANT_SHARE
from gateflow.operators import model
from gateflow.session import materialise


def dominant_values(df: DataFrame, columns: Sequence[str] | None = None,
                    share: float = QUASI_CONSTANT_SHARE) -> DataFrame:
    """Columns in which a single value (NULL counts as one) has more than ``share`` of the rows.

    A value with more than 90 % of the rows covers the middle of the column in any order. So the
    first pass takes the approximate median of the hashes as the only possible candidate, and the
    second counts it exactly: two scans, no shuffle of the values. Valid for shares above one half.
    """
    if share <= 0.55:
        raise ValueError("a dominant value needs a share well above one half")
    columns = list(columns or df.columns)
    middle = df.agg(*[F.expr(f"percentile_approx(hash(`{c}`), 0.5, 100) AS `{c}`") for c in columns]).first()
    aggs = []
    for c in columns:
        hit = f"hash(`{c}`) = {middle[c]}"
        # The value itself is counted: rows that only share its hash are told apart by min and max.
        low, high = (f"{fn}(`{c}`) FILTER (WHERE {hit})" for fn in ("min", "max"))
        aggs.append(F.expr(
            f"struct('{c}' AS column, count_if({hit}) AS _hits, count_if({hit} AND `{c}` IS NULL) AS _nulls, "
            f"count(1) AS _rows, coalesce({low} <> {high}, false) AS _mixed) AS `{c}`"))
    table = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns]))).collect()
    shares = {}
    for r in table:  # one row per column
        if r["_mixed"] or 0 < r["_nulls"] < r["_hits"]:  # colliding hashes: count the values themselves
            c = r["column"]
            counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            shares[c] = counts.agg(F.max("_n") / F.sum("_n")).first()[0]
        else:
            shares[r["column"]] = r["_hits"] / r["_rows"] if r["_rows"] else 0.0
    found = [(c, s) for c, s in shares.items() if s > share]
    return df.sparkSession.createDataFrame(found, "column STRING, topShare DOUBLE")


def drop_quasi_constant(df: DataFrame, columns: Sequence[str] | None = None,
                        share: float = QUASI_CONSTANT_SHARE) -> tuple[DataFrame, list[str]]:
    """Frame without its near-constant columns, and their names."""
    dropped = [r["column"] for r in dominant_values(df, columns, share).collect()]
    return df.drop(*dropped), dropped


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, all pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[F.expr(f"struct('{a}' AS a, '{b}' AS b, corr(`{a}`, `{b}`) AS correlation) AS p{i}")
                   for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))


def correlation_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of very many columns: one pass adds up the products of all pairs in one matrix.

    Missing values count as 0, as in the fits. A plan holds one vector of the columns, not a field for each pair. The
    matrix has a cell for each pair of columns; pairs with a constant column are left out.
    """
    columns = list(columns)
    rows = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows).select("_x")
    scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(vectors).transform(vectors)
    matrix = Correlation.corr(scaled, "_z").first()[0].toArray()
    found = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j and math.isfinite(matrix[i, j])]
    return df.sparkSession.createDataFrame(found, "a STRING, b STRING, correlation DOUBLE")


def partners(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seed: int = 0, suffix: str = "_other") -> DataFrame:
    """Every row with the values of another row: rows are ranked twice by seeded hashes, and equal ranks meet.

    The values of a column so joined are a shuffled copy of it, the same on every run.
    """
    own = model.ranked(df, keys, seed, "_rank")
    other = model.ranked(df.select(*dict.fromkeys([*keys, *columns])), keys, seed + 1, "_rank").select("_rank", *[F.col(c).alias(c + suffix) for c in columns])
    return own.join(other, "_rank").drop("_rank")


def permutation_importance(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str,
                           predict: Callable[[DataFrame], DataFrame], seed: int = 0) -> tuple[DataFrame, float]:
    """(feature, importance) and the error as it is: how much the mean absolute error grows once a column is shuffled.

    ``predict`` adds a column ``_pred``. All shuffled copies come from one join; each costs one scoring of the rows.
    """
    both = materialise(partners(rows, keys, columns, seed), "partners")

    def error(scored: DataFrame) -> float:
        return scored.agg(F.avg(F.abs(F.col(label) - F.col("_pred")))).first()[0]

    base = error(predict(both))
    grown = model.side_by_side([lambda c=c: error(predict(both.withColumn(c, F.col(f"{c}_other")))) - base for c in columns])
    return rows.sparkSession.createDataFrame(list(zip(columns, grown)), "feature STRING, importance DOUBLE"), base


def include(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def exclude(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def suffix_columns(df: DataFrame, suffix: str, keep: Sequence[str]) -> DataFrame:
    """Append a suffix to every column but the kept ones."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keep})
