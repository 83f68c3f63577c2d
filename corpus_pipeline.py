"""The corpus pipeline: language, toxicity, near duplicates, repeated passages, packing."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gateflow.llm import langid, packing, suffix_dedup, toxicity
from gateflow.llm.common import materialise, numbered, ship, table
from gateflow.llm.ngram_join import jaccard_components

LEAST_MARGIN = 1.04  # least probability of the best language, as a multiple of what each has if all learned ones are equally likely


def free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not use."""
    while name in docs.columns:
        name += "_"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or text, and those whose best language is hardly likelier than any other."""
    net, found = langid.train(docs), free(docs, "found")
    ship(spark)
    least = LEAST_MARGIN / max(1, len(net.languages)) if len(net.languages) > 1 else 0.0
    marked = docs.withColumn(found, langid.language(net, F.col("text")))
    return marked.filter((F.col(f"{found}.lang_pred") != langid.UNKNOWN) & (F.col(f"{found}.score") >= least)).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score reaches the threshold."""
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(scorer, F.col("text")) < toxicity.THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id, and all documents without an id.

    Near duplicates share 0.8 of their five-word shingles; op3's own contract is four words and 0.85. Rows equal in id
    and text are one document, of which one row stays. Unlike texts with one id are documents of their own.
    """
    content, number, row = (free(docs, c) for c in ("content", "number", "row"))
    named = docs.filter("doc_id IS NOT NULL").withColumn(content, F.xxhash64("text"))
    known = named.select("doc_id", content).distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        first = _first(docs, "doc_id")
        kept = named.join(first, "doc_id", "left_semi")
    else:  # documents are numbered in the order of their ids, and the numbers are linked
        numbers = materialise(numbered(known, ["doc_id", content], number), "pipeline-numbers")
        told = materialise(named.join(numbers, ["doc_id", content]), "pipeline-told")
        kept = told.join(_first(told, number), number, "left_semi")
    same = Window.partitionBy("doc_id", content).orderBy("text", *others)
    kept = kept.withColumn(row, F.row_number().over(same)).filter(F.col(row) == 1)
    return kept.select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def _first(docs: DataFrame, id_col: str) -> DataFrame:
    """Ids of the documents that stand for their groups."""
    classes = jaccard_components(docs, id_col=id_col, width=5, similarity=Fraction(80, 100))
    return classes.filter(F.col("component_id") == F.col(id_col)).select(id_col).distinct()


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes of passages that occur twice or more; documents stay, with what is left of them."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    done = suffix_dedup.remove_repeats(docs, keep=others, as_text=True)
    done = done.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("text").cast("long"))
    return done.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passage_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None  # the trained stages have no SQL; tests compare each stage with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its result to the shared folder, where the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
