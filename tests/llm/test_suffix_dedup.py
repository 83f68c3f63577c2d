import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gateflow.llm import suffix_dedup
from tests.llm.data import awkward, frame, words


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s: s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s: s + length]] > 1:
                gone[s: s + length] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,spread", [(400, 4096), (60, 3)])
def test_removed_bytes_equal_brute_force(spark, length, spread):
    ids, texts = awkward()
    passage = words(50, 25)
    texts += [words(60 + k, 15) + passage + words(80 + k, 15) for k in range(12)]  # one anchor, many regions
    texts += ["ab" * 400, "xé" * 300, "long " * 300]
    ids += [None, *range(100, 114)]
    done = suffix_dedup.remove_repeats(frame(spark, texts, ids), length=length, spread=spread, keep=("rep", "ranges"))
    got = done.withColumn("sha", F.sha2("kept", 256)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got) == Counter(
        (i, *x) for i, x in zip(ids, brute(texts, length), strict=True))
    assert {(r.rep, r.ranges) for r in got} == {(1, "r")}


def test_equal_rows_are_gone_and_leave_others_right(spark):
    whole, short, passage = words(40, 120), "short text", words(41, 90)
    texts = [whole] * 200 + [short] * 5 + [whole[:500] + " " + words(42, 60), passage + " x", "y " + passage, None, None]
    ids = [1] * 200 + [2] * 5 + [3, 4, 5, 6, 6]
    done = suffix_dedup.remove_repeats(frame(spark, texts, ids)).withColumn("sha", F.sha2("kept", 256)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in done) == Counter(
        (i, *x) for i, x in zip(ids, brute(texts, 400), strict=True))


@pytest.mark.parametrize("seed", range(30))
def test_two_stage_order(seed):
    rng = random.Random(seed)
    for _ in range(20):
        length, data, runs = rng.choice([4, 5, 8]), b"", []
        for _ in range(rng.randint(1, 4)):
            n = rng.randint(length, 30)
            runs.append((len(data), len(data) + n - length))
            data += bytes(rng.choice(b"abc"[: 2 + seed % 2]) for _ in range(n))
        order = suffix_dedup.suffix_order(data, runs, length)
        assert sorted(order) == [i for a, b in runs for i in range(a, b + 1)]
        keys = [data[i: i + length] for i in order]
        assert keys == sorted(keys)


def test_segments_find_the_same_anchors(monkeypatch):
    data = np.frombuffer(words(9, 3000).encode(), np.uint8)
    whole = suffix_dedup.regions(data, 100)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 10)
    parts = suffix_dedup.regions(data, 100)
    starts = lambda r: {(int(s), int(a)) for a, lo, hi in zip(r[0], r[2], r[3], strict=True) for s in range(lo, hi + 1)}
    assert {s for s, _ in starts(whole)} == {s for s, _ in starts(parts)} == set(range(len(data) - 99))


def test_remaining_text_needs_one_python_function(spark):
    """A second function in the stage doubled the workers, which later stages kept."""
    passage = words(50, 100)
    texts = ["é" * 3 + passage + "ß x", "è" + passage + "à", "é" * 401, None, "short \ufffd"]
    done = suffix_dedup.remove_repeats(frame(spark, texts), as_text=True, keep=("rep",))
    plan = done._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and done.schema["kept"].dataType.simpleString() == "string"
    plain = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    got = {r.doc_id: r.kept for r in done.collect()}
    assert got == plain and got[4] == texts[4] and got[3] == ""
    assert passage not in got[0]


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(frame(spark, ["x"]).limit(0)).count() == 0
