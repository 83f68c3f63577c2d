"""Token counts through a cache of digests: equal contents are encoded once, and never again with the same tokenizer."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateflow.llm.common import arrow_map

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
_models: dict = {}


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer file with the name and version of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    version = __import__(library).__version__
    return hashlib.sha256(Path(path).read_bytes() + f"{library} {version}".encode()).hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of the content that is counted. Counts depend on every character, so the only normalisation is null to empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _lengths(path: str, texts: list[str]) -> list[int]:
    if path not in _models:
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor
            model = SentencePieceProcessor(model_file=path)
            _models[path] = lambda some: [len(x) for x in model.encode(some, num_threads=1)]
        else:
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            _models[path] = lambda some: [len(x.ids) for x in library.encode_batch_fast(some, add_special_tokens=False)]
    return _models[path](texts)


def fill_cache(docs: DataFrame, cache: str, tokenizer: str, text_col: str = "text") -> None:
    """Append the counts of all contents of ``docs`` that the cache does not have for this tokenizer.

    Copies of a content meet by partial aggregation before the shuffle, so a text that fills a third of the table
    costs each task one row. Appending is one atomic write; run again after a failure, only what is missing is encoded.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    known = cached_counts(spark, cache, version)
    contents = (docs.select(content_digest(F.col(text_col)).alias("content"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                .groupBy("content").agg(F.first("text").alias("text")))
    missing = contents if known is None else contents.join(known, "content", "left_anti")

    def count(batch):
        return {"content": batch.column(0), "tokenizer": pa.array([version] * batch.num_rows),
                "n_tokens": _lengths(tokenizer, batch.column(1).to_pylist())}

    arrow_map(missing, count, CACHE_SCHEMA, rows=64).write.mode("append").parquet(cache)


def cached_counts(spark, cache: str, version: str) -> DataFrame | None:
    """(content, n_tokens) that the cache holds for a tokenizer; None where there is no cache yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))  # two writers may have met


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, as the tokenizer's library counts; a null text is empty."""
    fill_cache(docs, cache, tokenizer, text_col)
    known = cached_counts(docs.sparkSession, cache, tokenizer_version(tokenizer))
    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       content_digest(F.col(text_col)).alias("content"))
    return rows.join(known, "content").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
