"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, rep long, next string, key string, "
          "length long, ids string, component long, ranges string")


def frame(spark, texts, ids=None, langs=None):
    rows = [(i, t, lang, "s", None if t is None else len(t), 1, "n", "k", 5, "i", 9, "r")
            for i, t, lang in zip(ids or range(len(texts)), texts, langs or ["en"] * len(texts), strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward():
    """(ids, texts)"""
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = words(2, 110)
    texts = [base, " ".join(near), base, words(3, 80) + "\n" + passage, passage + " " + words(4, 30), None, "", "   \n\t ", "One.",
             "é" * 5, words(5, 20_000), "a" * 900, "The\x0bThe THE the", "ß 日本 ▁x <|endoftext|> <s>", base, None, "No word here! No? Yes."]
    ids = [30, 20, 40, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 30, None, None]
    return ids, texts
