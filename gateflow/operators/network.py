"""Station network and weather features.

A matrix is kept as its non-zero cells (row, column); products with it are joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateflow.session import materialise

# Second start vectors of the iterations: any fixed numbers that differ between columns.
ROAD_START = "dst % 7 + 1"
WEATHER_START = "length(cell) % 5 + 0.5 * (ascii(right(cell, 2)) % 4)"


def neighbour_ranks(edges: DataFrame) -> DataFrame:
    """Every neighbour of every station with its rank in id order: (stationID, rank, neighbour)."""
    w = Window.partitionBy("src").orderBy("dst")
    return edges.select(F.col("src").alias("stationID"), F.row_number().over(w).alias("rank"), F.col("dst").alias("neighbour"))


def neighbours(edges: DataFrame) -> DataFrame:
    """All neighbours of each station in id order, as ``map00, map01, ...``: as many columns as the largest degree."""
    ranked = materialise(neighbour_ranks(edges), "neighbours")
    width = ranked.agg(F.max("rank")).first()[0] or 0
    return ranked.groupBy("stationID").agg(F.count(F.lit(1)).alias("_n"), *[
        F.max(F.when(F.col("rank") == i + 1, F.col("neighbour"))).alias(f"map{i:02d}") for i in range(width)]).drop("_n")


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """All neighbours of each station as one sorted array."""
    return edges.groupBy(F.col("src").alias("stationID")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("stationID")).agg(F.count(F.lit(1)).alias("degree"))


def graph_checks(edges: DataFrame) -> DataFrame:
    """Connected pairs, their share of all pairs, and how many edges lack their reverse."""
    both = edges.select("src", "dst", F.lit(1).alias("_s")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(-1).alias("_s")))
    cells = both.groupBy("src", "dst").agg(F.sum("_s").alias("_s"), F.count_if(F.col("_s") == 1).alias("_n"))
    stations = edges.select("src").union(edges.select("dst")).distinct().agg(F.count(F.lit(1))).scalar()
    return cells.agg(F.sum("_n").alias("pairs"), F.count_if(F.col("_s") != 0).alias("unmatched")).select(
        "pairs", (F.col("pairs") / (stations * stations)).alias("share"),
        (F.col("unmatched") == 0).cast("int").alias("symmetric"))


def _turn(cells: DataFrame, vectors: DataFrame, by: str, onto: str) -> DataFrame:
    """Product of the 0/1 matrix with two vectors: (onto, x, y), sums over the cells of each ``onto``."""
    return cells.join(vectors, by).groupBy(onto).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def svd_features(cells: DataFrame, row: str, column: str, names: Sequence[str], start: str, rounds: int = 10) -> DataFrame:
    """Rank-2 embedding of the rows of a 0/1 matrix: left vectors times singular values.

    Orthogonal iteration from fixed start vectors, 1 and the SQL expression ``start`` of the column id. Products with
    the matrix are joins and aggregations; only three inner products of a round reach the driver. Signs are such
    that the first vector has a positive sum and so has the second one weighted by ``start``.
    """
    cells = materialise(cells.select(row, column).distinct(), "cells")
    vectors = cells.select(column).distinct().select(column, F.lit(1.0).alias("x"), F.expr(start).cast("double").alias("y"))
    for _ in range(rounds):
        turned = materialise(_turn(cells, _turn(cells, vectors, column, row), row, column), "vectors")
        xx, xy = turned.agg(F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y"))).first()
        if not xx:
            break
        y = F.col("y") - F.lit(xy / xx) * F.col("x")
        yy = turned.agg(F.sum(y * y)).first()[0]
        vectors = turned.select(column, (F.col("x") / F.lit(xx ** 0.5)).alias("x"), (y / F.lit(yy ** 0.5) if yy else F.lit(0.0)).alias("y"))
    signs = vectors.agg(F.sum("x").alias("x"), F.sum(F.col("y") * F.expr(start)).alias("y")).first()
    flip = [-1.0 if (signs[c] or 0) < 0 else 1.0 for c in ("x", "y")]
    return _turn(cells, vectors, column, row).select(row, *[(F.col(c) * F.lit(f)).alias(n) for c, f, n in zip(("x", "y"), flip, names)])


def nmf_features(edges: DataFrame, iterations: int = 10, start: tuple[str, str] = ("1 + 0.5 * ({0} % 3)", "1 + 0.25 * ({0} % 5)")) -> DataFrame:
    """Non-negative rank-2 factors of the adjacency matrix by multiplicative updates for the squared error.

    The factors start from fixed expressions of the ids. An update multiplies each factor by the quotient of two
    products; those with the matrix are joins, and only the 2 x 2 products of a factor with itself reach the driver.
    """
    cells = materialise(edges.select("src", "dst").distinct(), "cells")

    def first(name: str) -> DataFrame:
        x, y = (F.expr(e.format(name)).cast("double") for e in start)
        return cells.select(name).distinct().select(name, x.alias("x"), y.alias("y"))

    def update(own: DataFrame, other: DataFrame, by: str, onto: str) -> DataFrame:
        xx, xy, yy = other.agg(F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y"))).first()
        top = _turn(cells, other, by, onto).select(onto, F.col("x").alias("_x"), F.col("y").alias("_y"))
        x, y = F.col("x"), F.col("y")
        return materialise(own.join(top, onto).select(
            onto, F.coalesce(F.try_divide(x * F.col("_x"), x * F.lit(xx) + y * F.lit(xy)), F.lit(0.0)).alias("x"),
            F.coalesce(F.try_divide(y * F.col("_y"), x * F.lit(xy) + y * F.lit(yy)), F.lit(0.0)).alias("y")), "factors")

    w, h = first("src"), first("dst")
    if cells.isEmpty():
        iterations = 0
    for _ in range(iterations):
        h = update(h, w, "src", "dst")
        w = update(w, h, "dst", "src")
    return w.select(F.col("src").alias("stationID"), F.col("x").alias("mapNMF1"), F.col("y").alias("mapNMF2"))


def road_features(edges: DataFrame) -> DataFrame:
    """Embedding and neighbour list per station."""
    svd = svd_features(edges.withColumnRenamed("src", "stationID"), "stationID", "dst", ["mapSVD1", "mapSVD2"], ROAD_START)
    return svd.join(nmf_features(edges), "stationID", "left").join(neighbours(edges), "stationID", "left")


def one_hot(df: DataFrame, column: str, categories: Sequence[str] | None = None) -> DataFrame:
    """0/1 column per category. Without ``categories`` the distinct values name the columns, which only a schema can
    hold; ``one_hot_cells`` is the form for columns with very many values."""
    if categories is None:
        found = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
        categories = [r[0] for r in found.collect()]
    return df.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == F.lit(c)).cast("int"), F.lit(0))
                           for c in categories})


def one_hot_cells(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The ones of a concatenated one-hot matrix: (key, "column=value")."""
    pairs = F.explode(F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in columns]))
    return df.select(key, pairs.alias("cell")).filter(F.col("cell").isNotNull())


def weather_features(weather: DataFrame) -> DataFrame:
    """Rank-2 embedding of the one-hot coded condition and wind of each day."""
    return svd_features(one_hot_cells(weather, "day", ["weat", "wind"]), "day", "cell", ["weatsvd1", "weatsvd2"], WEATHER_START)


def enrich(flow: DataFrame, stations: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Station and day attributes on every flow row; the optimiser broadcasts them when they are small."""
    if stations is not None:
        flow = flow.join(stations, "stationID", "left")
    return flow.join(days, "day", "left") if days is not None else flow
