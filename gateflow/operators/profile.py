"""Column profiles, data checks and table comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateflow.session import materialise

_WIDTHS = (("tinyint", 2 ** 7), ("smallint", 2 ** 15), ("int", 2 ** 31))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _missing(df: DataFrame, column: str) -> str:
    """Condition for NULL or, in floating columns, NaN."""
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return f"`{column}` IS NULL" + (f" OR isnan(`{column}`)" if floating else "")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Minimum, maximum, missing count and smallest sufficient type of numeric columns, in one pass.

    A column counts as integral when its fractions sum to less than 0.01. Where values are missing,
    room is left for the marker one below the minimum that replaces them.
    """
    columns = list(columns or numeric_columns(df))
    aggs = []
    for c in columns:
        missing = _missing(df, c)
        x = f"CASE WHEN NOT ({missing}) THEN cast(`{c}` AS double) END"
        aggs.append(F.expr(
            f"struct('{c}' AS column, min({x}) AS min, max({x}) AS max, count_if({missing}) AS missing, "
            f"sum({x} - CASE WHEN `{c}` < 0 THEN ceil({x}) ELSE floor({x}) END) AS _fraction) AS `{c}`"))
    low = F.when(F.col("missing") > 0, F.col("min") - 1).otherwise(F.col("min"))
    narrow = F.lit("bigint")
    for name, bound in reversed(_WIDTHS):
        narrow = F.when((low >= -bound) & (F.col("max") < bound), F.lit(name)).otherwise(narrow)
    kind = F.when(F.abs("_fraction") < 0.01, narrow).otherwise(F.lit("float"))
    return (
        df.agg(*aggs).select(F.inline(F.array(*[F.col(c) for c in columns])))
        .withColumn("type", kind).drop("_fraction")
    )


def narrow(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Cast numeric columns to their smallest type; missing values become minimum - 1.

    Returns the frame and the columns that were filled. The driver only sees one row per column.
    """
    filled, out = [], {}
    for row in column_profile(df, columns).collect():
        c = F.col(row["column"])
        if row["missing"]:
            filled.append(row["column"])
            c = F.when(F.expr(_missing(df, row["column"])), F.lit(row["min"] - 1)).otherwise(c)
        out[row["column"]] = c.cast(row["type"])
    return df.withColumns(out), filled


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column and value (as text, NULL included), counted map-side first."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share of every value of every listed column."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return value_counts(df, columns).withColumn("share", F.col("n") / total)


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of the most frequent value and number of distinct values per column."""
    return value_frequencies(df, columns).groupBy("column").agg(
        F.max("share").alias("topShare"), F.count("value").alias("nunique"))


def summary(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, distinct values, most frequent value, moments and exact quantiles per column.

    Everything comes from the value counts. For the quantiles the distinct numbers are dealt by ranges of (column,
    value); sums per range tell each range the rank it starts at, so no task holds a whole column. ``top`` is NULL if no
    value occurs twice.
    """
    spark = df.sparkSession
    numeric = [c for c in columns if c in set(numeric_columns(df))]
    number = F.when(F.col("column").isin(numeric), F.col("value").cast("double")) if numeric else F.lit(None).cast("double")
    counts = value_counts(df, columns).filter(F.col("value").isNotNull()).withColumn("x", number)
    dealt = materialise(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "column", "x", "value")
                        .withColumn("part", F.spark_partition_id()), "summary")
    x, n = F.col("x"), F.col("n")
    total = F.sum(F.when(x.isNotNull(), n))
    mean = F.sum(x * n) / total
    variance = F.try_divide(F.sum(x * x * n) - F.sum(x * n) * F.sum(x * n) / total, total - 1)
    moments = dealt.groupBy("column").agg(
        F.sum(n).alias("count"), F.count(n).alias("unique"), F.max(F.struct(n, F.col("value")))["value"].alias("top"),
        F.max(n).alias("freq"), mean.alias("mean"), F.sqrt(variance).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        total.alias("_total"))
    parts = dealt.filter("x IS NOT NULL").groupBy("column", "part").agg(F.sum("n").alias("held"))
    before = parts.select("column", "part", (F.sum("held").over(Window.partitionBy("column").orderBy("part")) - F.col("held")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("column", "part").orderBy("x"))
    ranked = (dealt.filter("x IS NOT NULL").withColumn("inside", inside).join(before, ["column", "part"])
              .join(moments.select("column", "_total"), "column").withColumn("upto", F.col("before") + F.col("inside")))
    picks = []
    for q in quantiles:
        place = F.lit(q) * (F.col("_total") - 1)
        low, high = (F.min(F.when(F.col("upto") > f(place), x)) for f in (F.floor, F.ceil))
        share = F.max(place - F.floor(place))
        picks.append((low + (high - low) * share).alias(f"q{int(q * 100)}"))
    found = moments.join(ranked.groupBy("column").agg(*picks), "column", "left").drop("_total")
    return found.withColumn("top", F.when(F.col("freq") > 1, F.col("top")))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, one pass."""
    counts = df.agg(*[F.expr(f"struct('{c}' AS column, count_if({_missing(df, c)}) AS nulls) AS `{c}`")
                      for c in df.columns])
    return counts.select(F.inline(F.array(*[F.col(f"`{c}`") for c in df.columns])))


def outlier_checks(swipes: DataFrame, closed_station: int, first, last) -> DataFrame:
    """Is the closed station present, does any time lie outside the days, do all rows have a known status."""
    day = F.to_date("time")
    return swipes.agg(
        F.coalesce(F.bool_or(F.col("stationID") == closed_station), F.lit(False)).cast("int").alias("closedSeen"),
        F.coalesce(F.bool_or((day < F.lit(first)) | (day > F.lit(last))), F.lit(False)).cast("int").alias("timeOutside"),
        F.coalesce(F.bool_and(F.col("status").isin(0, 1)), F.lit(True)).cast("int").alias("statusKnown"),
    )


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with the surplus on either side; empty when equal.

    Both sides are summed as +1 / -1 per distinct row: one shuffle instead of two set differences.
    """
    sides = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    return sides.groupBy(*a.columns).agg(F.sum("_side").alias("surplus")).filter(F.col("surplus") != 0)


def datasets_equal(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b).isEmpty()


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
