"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

A unit vector is rotated at random; its code is the signs of the rotated vector, and its correction factor is how well the
code points in the vector's direction. With it the code gives an unbiased estimate of an inner product, with a known
confidence bound. Bands of bits of further rotations bring vectors together that may be close; in a band's bucket, pairs
whose upper bound stays below the threshold are left, and the others are computed exactly in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.common import arrow_map, grouped, materialise
from gateflow.llm.components import connected_components

CODE_BITS = 256     # length of a code; the error of an estimate falls with its square root
CONFIDENCE = 4.0    # standard errors on each side of an estimate
MISSED = 1e-3       # share of pairs at the threshold that may share no band
BUCKET = 256        # vectors that a bucket holds on average
BLOCK = 1024        # vectors of a block; a larger bucket is compared block by block


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """(bits, dim) matrix of random orthonormal rows or, for more bits than dimensions, of a rotation of a larger space."""
    size = max(bits, dim)
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(size, size)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:bits, :dim])


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (-1 or 1) of the rotated unit vectors and their correction factors."""
    rotated = unit @ turn.T
    signs = np.where(rotated >= 0, 1.0, -1.0)
    return signs, (rotated * signs).sum(axis=1) / math.sqrt(turn.shape[0]) / np.linalg.norm(rotated, axis=1)


def bounds(signs: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of coded vectors (rows) with rotated unit vectors (columns), and their error bounds."""
    n = signs.shape[1]
    estimate = (signs @ rotated.T) / math.sqrt(n) / factor[:, None]
    error = CONFIDENCE * np.sqrt((1 - factor ** 2) / factor ** 2 / max(1, n - 1))
    return estimate, error[:, None]


def bands(rows: float, threshold: float, bucket: int = BUCKET, missed: float = MISSED) -> tuple[int, int]:
    """Bits of a band and number of bands for groups of up to ``rows`` vectors.

    A bit of two vectors at the threshold agrees with probability 1 - angle / pi. Bits grow with the logarithm of the
    rows, so buckets keep their size; the number of bands keeps the share of missed pairs.
    """
    bits = max(4, math.ceil(math.log2(max(2.0, rows / bucket))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(missed) / math.log(1 - same)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles with norm 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.98, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; rows of equal label link if their cosine reaches the threshold.

    Rows without a label, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing. Only vectors of equal length are compared. Equal vectors of a label are one with a count; every row is a
    vector of its own, also if ids repeat. A row with a null id is counted but has a null component.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    good = (F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
            & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    # equal up to a factor is equal; -0.0 becomes 0.0
    largest = F.array_max(F.transform("v", lambda x: F.abs(x).cast("double")))
    scaled = F.transform("v", lambda x: x.cast("double") / largest + F.lit(0.0)).cast("array<string>")
    usable = rows.filter(F.coalesce(good, F.lit(False))).withColumn(
        "key", F.sha2(F.concat_ws(",", F.col("label").cast("string"), scaled), 256))
    usable = materialise(usable, "codes-usable")
    distinct = materialise(usable.groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"), F.first("label").alias("label"),
                                                     F.first("v").alias("v")).filter("rep IS NOT NULL").withColumn("dim", F.size("v")), "codes-distinct")
    groups = distinct.groupBy("label", "dim").agg(F.count("*").alias("n"))
    largest_group = groups.agg(F.max("n")).first()[0] or 0
    bits, count = bands(largest_group, threshold, bucket)

    def deal(batch):
        """A row for each band of each vector; all vectors of a batch slice have one length."""
        dims = batch.column(3).to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            unit = _matrix(part.column(2))
            signature = np.zeros((len(unit), count), np.int64)
            for turn in range(-(-bits * count // dim)):  # as many rotations as the bits need
                bit = (unit @ rotation(int(dim), int(dim), 100 + turn).T) >= 0
                for k in range(int(dim)):
                    at = turn * int(dim) + k
                    if at < bits * count:
                        signature[:, at // bits] |= bit[:, k].astype(np.int64) << (at % bits)
            n = len(unit)
            spread = pa.array(np.repeat(np.arange(n), count))
            yield {"key": part.column(5).take(spread), "rep": part.column(0).take(spread), "copies": part.column(4).take(spread), "label": part.column(1).take(spread),
                   "dim": part.column(3).take(spread), "band": np.tile(np.arange(count, dtype=np.int32), n), "bucket": signature.ravel(),
                   "signature": pa.array(signature.tolist()).take(spread), "v": part.column(2).take(spread)}

    kind = distinct.schema["label"].dataType.simpleString()
    dealt = materialise(arrow_map(distinct.select("rep", "label", "v", "dim", "copies", "key"), deal,
                                  f"key string, rep long, copies long, label {kind}, dim int, band int, bucket long, signature array<long>, v {distinct.schema['v'].dataType.simpleString()}", rows=256), "codes-dealt")
    place = ["label", "dim", "band", "bucket"]
    sized = dealt.groupBy(*place).agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    placed = dealt.join(sized, place).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # every pair of blocks of a bucket once: a block goes to the pairs (part, x) with x >= part and (x, part) with x < part
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns(
        {"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, copies = (table.column(c).to_numpy() for c in ("rep", "copies"))
        part, band = table.column("part").to_numpy(), int(table.column("band")[0].as_py())
        low, high = int(table.column("low")[0].as_py()), int(table.column("high")[0].as_py())
        unit = _matrix(table.column("v").combine_chunks())
        before = np.array(table.column("signature").to_pylist(), np.int64).reshape(len(rep), -1)[:, :band]
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        turn = rotation(unit.shape[1], max(CODE_BITS, unit.shape[1]), 7)
        signs, factor = codes(unit, turn)
        rotated = unit @ turn.T
        links = np.zeros(len(rep), np.int64)
        up = np.arange(len(rep))

        def root(i):
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for at in range(0, len(left), 256):
            some = left[at: at + 256]
            estimate, error = bounds(signs[some], factor[some], rotated[right])
            maybe = estimate + error >= threshold
            if low == high:
                maybe &= some[:, None] < right[None, :]
            a, b = np.nonzero(maybe)
            for k in range(0, len(a), 1 << 16):
                i, j = some[a[k: k + (1 << 16)]], right[b[k: k + (1 << 16)]]
                # exactly, and only in the first band that the two share
                real = (np.einsum("nd,nd->n", unit[i], unit[j]) >= threshold) & ~(before[i] == before[j]).any(axis=1)
                i, j = i[real], j[real]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = root(x), root(y)
                    if x != y:
                        up[max(x, y)] = min(x, y)
        tops = np.array([root(i) for i in range(len(rep))])
        some = np.flatnonzero((links > 0) | (tops != np.arange(len(rep))))
        return pa.table({"key": table.column("key").take(pa.array(some)), "rep": rep[some], "links": links[some], "top": rep[tops[some]]})

    found = materialise(grouped(met.select(*place, "low", "high", "part", "key", "rep", "copies", "signature", "v"), [*place, "low", "high"], compare,
                                "key string, rep long, links long, top long"), "codes-found")
    same = usable.join(distinct.select("key", "rep"), "key").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    classes = connected_components(found.select(F.col("rep").alias("u"), F.col("top").alias("v")).union(same), "codes-classes")
    totals = found.groupBy("key").agg(F.sum("links").alias("others"))  # unlike vectors may share an id, never a key
    counts = distinct.select("key", "copies").join(totals, "key", "left").select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    per_row = usable.join(counts, "key").select("vec_id", "n_links").union(
        rows.filter(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long"))).union(
        usable.join(distinct.select("key"), "key", "left_anti").select("vec_id", F.lit(0).cast("long")))
    out = per_row.join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
