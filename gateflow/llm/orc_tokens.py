"""Token ids in ORC files: sorted by document id, with row indexes and Bloom filters that let readers skip stripes.

Spark's ORC writer stores the ids with integer run-length encoding. Files hold ascending, disjoint ranges of document ids
in the order of their names, so they and their stripes can be read side by side, and a filter on the document id prunes
files and stripes by their statistics and row groups by Bloom filters.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gateflow.llm.common import arrow_map, materialise, shuffle_width
from gateflow.llm.tokens import word_encoder

OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1,
                 files: int | None = None) -> None:
    """Write (doc_id, ids) of every row to ``folder`` in ascending order of doc_id, null ids first.

    A null text is empty; ``end`` follows the ids of every text. Texts are dealt by ranges of ids before they are
    encoded, because they take less room in a shuffle than their ids. Rows with equal ids stay in one file, in the
    order of their texts.
    """
    def run(batch):
        use, tail = word_encoder(tokenizer), int(end).to_bytes(4, "little")
        ids = [x + tail for x in use.encode(batch.column(1))]
        bounds = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
        return {"doc_id": batch.column(0),
                "ids": pa.ListArray.from_arrays(bounds, pa.array(np.frombuffer(b"".join(ids), np.int32)))}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = (rows.repartitionByRange(files or shuffle_width(docs.sparkSession), "doc_id")
             .sortWithinPartitions("doc_id", F.xxhash64("text")))
    arrow_map(dealt, run, "doc_id long, ids array<int>", rows=256, needs=("words",)).write.options(**OPTIONS).orc(folder)


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, ids, file) of the documents with ids from ``first`` to ``last``; the bounds prune files and stripes."""
    rows = spark.read.schema("doc_id long, ids array<int>").orc(folder)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))


def token_offsets(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows from ``read_tokens``: start counts the ids of all documents before."""
    def run(batch):
        ids = batch.column(1)
        bounds = ids.offsets.to_numpy()
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype(np.uint32, copy=False))
        return {"doc_id": batch.column(0), "file": batch.column(2), "n_tokens": np.diff(bounds).astype(np.int64),
                "ids_crc32": [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}

    counted = materialise(arrow_map(rows.select("doc_id", "ids", "file"), run, "doc_id long, file int, n_tokens long, ids_crc32 long"),
                          "orc-counted")  # a narrow table, read twice below
    # a row per file: what all files before it hold
    totals = counted.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    before = totals.withColumn("before", F.sum("held").over(Window.orderBy("file")) - F.col("held")).select("file", "before")
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens")
                                    .rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return (counted.withColumn("inside", inside).join(before, "file")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
