"""Lines that many documents hold, found with levelled, sorted runs of line hashes.

A run is a table of the keys (two 64-bit hashes of a normalised line) of one batch of documents: how many documents of
the batch hold a key, the largest of their ids, and whether the key is fresh. A new batch is anti-joined with all runs
by an outer merge join that keeps both halves: keys without a partner are fresh and belong to the new run from then on,
the others are repeats, which add their counts only. So a key is fresh in one run at most, and later batches look at the
fresh keys alone.
Runs of a level are compacted by merging them. They are bucketed and sorted by the key, so neither anti-joins nor
compactions shuffle a run again; their files aren't compressed, as hashes don't shrink.

Everything is DataFrame functions. A hot line reaches a shuffle as one row of a document, then as partial counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.llm.common import materialise, salted, shuffle_width
from gateflow.session import run_folder

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.trim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, least_chars: int, batches: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2, batch) of the lines whose key has ``least_chars`` code points; rows of one id share a batch."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("line"))
    return keys.filter(F.char_length("line") >= least_chars).select(
        "doc_id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        salted(batches, "doc_id").alias("batch"))


class LineRuns:
    """Levels of runs; ``fan`` runs of one level become one run of the next.

    Batches hold whole documents, and no document is in two of them. Files are external tables in the shared folder;
    ``close`` takes their names out of the catalog.
    """

    def __init__(self, spark: SparkSession, fan: int = 2, buckets: int | None = None):
        self.spark, self.fan, self.buckets = spark, fan, buckets or shuffle_width(spark)
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, rows: DataFrame) -> str:
        """Store rows that are dealt by the key; what comes out of a merge with runs still is."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.names.append(name)
        (rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("compression", "uncompressed")
         .option("path", run_folder(self.spark, name)).saveAsTable(name))
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name).hint("merge")

    def add(self, lines: DataFrame) -> None:
        """Take the lines (doc_id, h1, h2) of a batch in."""
        counts = lines.select("doc_id", *KEY).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"))
        rows = counts.repartition(self.buckets, *KEY).withColumn("fresh", F.lit(True))
        for name in self.runs():
            known = self._read(name).filter("fresh").select(*KEY, F.lit(True).alias("known"))
            rows = rows.join(known, KEY, "left").select(*KEY, "n_docs", "last", (F.col("fresh") & F.col("known").isNull()).alias("fresh"))
        self._push(self._write(rows), 0)

    def _push(self, run: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            runs, self.levels[level] = self.levels[level], []
            self._push(self._write(self._merged(runs)), level + 1)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged by key, two at a time: an outer merge join of two runs is dealt like them, its result isn't known to be."""
        names = list(names)
        while len(names) > 2:
            names = names[2:] + [self._write(self._merged(names[:2]))]
        rows = self._read(names[0])
        if len(names) == 1:
            return rows
        other = self._read(names[1]).select(*KEY, F.col("n_docs").alias("n"), F.col("last").alias("l"), F.col("fresh").alias("f"))
        return rows.join(other, KEY, "full").select(
            *KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last", "l").alias("last"),
            (F.coalesce("fresh", F.lit(False)) | F.coalesce("f", F.lit(False))).alias("fresh"))

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, last, fresh) of every key over all batches."""
        return self._merged(self.runs())

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 5,
                        least_chars: int = 40, batches: int = 4, fan: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every text without the lines that ``least_docs`` documents or more hold.

    Lines end at line feeds. Of a key (see ``line_key``) with ``least_chars`` code points or more, all lines go but those
    in the document with the largest id that holds it. A null or empty text is one empty line. Rows with equal ids are
    one document; each row keeps its own text. A null id is one document, which comes before all others. Any other
    columns are left alone; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = line_hashes(docs, id_col, text_col, least_chars, batches)
    folder = run_folder(spark, "line-hashes")
    found.write.partitionBy("batch").option("compression", "uncompressed").parquet(folder)  # texts are read once for this, narrow rows afterwards
    hashed = spark.read.schema(found.schema).parquet(folder)
    runs = LineRuns(spark, fan)
    try:
        for batch in range(batches):
            runs.add(hashed.filter(F.col("batch") == batch))
        hot = materialise(runs.totals().filter(F.col("n_docs") >= least_docs).select(*KEY, "last"), "hot-lines")
    finally:
        runs.close()
    gone = hashed.join(hot, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    # dropped lines of a text as bits, 64 lines to a word
    words = (gone.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("block"))
             .agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("word")))
    bits = (words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("block", "word"))).alias("words"),
                                                    F.sum(F.bit_count("word")).alias("n_dropped"), F.max("block").alias("blocks"))
            .select(F.col("doc_id").alias("of"), "text_hash", "n_dropped",
                    F.expr("transform(sequence(0, blocks), b -> coalesce(words[b], 0L))").alias("words")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                        F.xxhash64(F.col(text_col)).alias("text_hash"))
    both = texts.alias("t").join(bits.alias("b"), F.expr("t.doc_id <=> b.of AND t.text_hash = b.text_hash"), "left")
    keep = F.expr("array_join(filter(split(text, '\\n'), (line, i) -> i div 64 >= size(words)"
                  " OR getbit(words[cast(i div 64 AS int)], i % 64) = 0), '\\n')")
    return both.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                       F.when(F.col("words").isNull(), F.col("text")).otherwise(keep).alias("kept"))
