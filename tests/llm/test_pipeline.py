"""The pipeline stage by stage against plain versions, on a small table with planted cases."""

import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tests.llm import test_ngram_join, test_suffix_dedup
from tests.llm.data import words
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    texts = [words(k, 70, 300) for k in range(60)]
    for k in range(0, 60, 4):  # toxic documents
        parts = texts[k].split()
        for _ in range(4):
            parts.insert(rng.randrange(70), "idiot")
        texts[k] = " ".join(parts)
    near = texts[1].split()
    near[30] = "other"
    passage = words(900, 90, 300)
    texts += [" ".join(near), texts[2], texts[2], words(70, 20, 300) + " " + passage, passage + " " + words(71, 20, 300), None, "", "12 + 34"]
    ids = [*range(60), 100, 101, 101, 103, 104, 105, 106, None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, int(i % 4 == 0)) for i in range(60)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(k.columns == COLUMNS for k in kept[:-1])
    languages, toxicity, near_copies, passages, packed = ([tuple(r) for r in k.collect()] for k in kept[1:])
    assert sorted(r[0] for r in languages) == sorted(i for i in ids if i not in (105, 106, None))
    assert sorted(r[0] for r in toxicity) == sorted(r[0] for r in languages if not (r[0] < 60 and r[0] % 4 == 0))
    plain = test_ngram_join.brute([r[0] for r in toxicity], [r[1] for r in toxicity], 5, 80)
    assert sorted(r[0] for r in near_copies) == sorted({int(i) for i, _, root in plain if i == root})
    assert 100 not in {r[0] for r in near_copies} and 101 not in {r[0] for r in near_copies}
    before = {r[0]: r[1] for r in near_copies}
    want = dict(zip(before, test_suffix_dedup.brute(list(before.values()), 400), strict=True))
    for i, text, *_, n_chars in passages:
        assert len(text.encode()) == want[i][0] - want[i][1] and n_chars == len(text)
    assert any(w[1] for w in want.values())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in kept[-1].collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t, *_ in passages}
    assert len(packed) >= len(passages)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passage_stage_runs_one_python_function_after_the_last_join(spark):
    """With two of them every executor had twice as many workers, up to packing."""
    passage = words(900, 90, 300)
    rows = [(k, words(k, 20) + " " + passage, "en", "s", 1) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    done = corpus_pipeline.repeated_passage_stage(spark, docs, "")
    plan = done._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert all(passage not in r.text and r.n_chars == len(r.text) for r in done.collect())


def test_near_duplicates_by_five_words_and_four_fifths(spark):
    """Two edits of 100 words: likeness 86 / 106 of five-word shingles, 89 / 105 of four-word ones; three edits: 81 / 111."""
    base, rows = words(500, 100, 10**6).split(), []
    for i, edits in enumerate([(), (30, 60), (20, 50, 80)]):
        text = " ".join("edited" + str(k) if k in edits else w for k, w in enumerate(base))
        rows.append((i, text, "en", "s", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").sort("doc_id").collect()] == [0, 2]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found long, number long, content string, row string, kept string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8, "c", "r", "k") for i, t in rows], SCHEMA)


def test_equal_ids_with_unlike_texts_are_documents_of_their_own(spark):
    a, b = words(600, 60), words(601, 60)
    rows = [(1, a), (1, b), (2, b), (3, a), (1, a), (4, words(602, 60)), (None, a), (None, a)]
    got = corpus_pipeline.near_duplicate_stage(spark, documents(spark, rows), "")
    assert got.columns == documents(spark, []).columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, a), (1, b), (4, rows[5][1]), (0, a), (0, a)])
    assert {(r.found, r.number, r.content, r.row) for r in got.collect()} == {(7, 8, "c", "r")}


def test_language_stage_keeps_columns_and_rejects_what_no_language_fits(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(["the", "house", "and", "water", "of"], k=30))) for k in range(40)]
    rows += [(100 + k, " ".join(rng.choices(["der", "und", "wasser", "ein", "haus"], k=30))) for k in range(40)]
    docs = documents(spark, rows + [(300, "12 34"), (301, None), (302, words(7, 20_000))])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") >= 100, "de").otherwise("en"))
    got = corpus_pipeline.language_stage(spark, docs, "")
    assert got.columns == docs.columns and {r.found for r in got.collect()} == {7}
    assert {r.doc_id for r in got.collect()} >= {i for i, _ in rows} and not {300, 301} & {r.doc_id for r in got.collect()}
    monkeypatch.setattr(corpus_pipeline, "LEAST_MARGIN", 2.1)  # more than certain with two languages
    assert corpus_pipeline.language_stage(spark, docs, "").count() == 0
