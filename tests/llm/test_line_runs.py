import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gateflow.llm import line_runs
from tests.llm.data import awkward, frame, words

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(line_runs.UPPER, line_runs.LOWER)


def key(line):
    return line.strip(BLANK).translate(LOWER)


def brute(rows, least_docs, least_chars):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(i)
    hot = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lined():
    """Documents that share lines in many ways: other case, blanks around, at the ends, twice in a text, over 64 lines apart."""
    shared = ["This line is in many documents, and it is a LONG one Été", "another line that a good number of texts hold, too", "short"]
    ids, texts = [], []
    for n in range(40):
        own = [words(n, 12) for _ in range(n % 5)]
        lines = own + [shared[0].upper().replace("ÉTÉ", "Été") if n % 2 else "\t " + shared[0] + "\r"] * (n % 3)
        lines += [f"{shared[1]} {n % 7}", shared[2], ""] * (1 + n % 2)
        ids.append(100 - n)
        texts.append("\n".join(lines))
    ids += [60, 60, None, None, 100, 3]
    texts += [shared[0] + "\n" + shared[0], texts[0], shared[0], shared[0] + "\nx", shared[0], "\n".join([shared[0], *(f"y{k}" for k in range(150)), shared[0] + " ", "z"])]
    return ids, texts


@pytest.mark.parametrize("batches,fan", [(1, 2), (5, 2)])
def test_lines_equal_brute_force(spark, batches, fan):
    ids, texts = awkward()
    more_ids, more = lined()
    ids, texts = ids + more_ids, texts + more
    got = line_runs.drop_repeated_lines(frame(spark, texts, ids), batches=batches, fan=fan)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(list(zip(ids, texts, strict=True)), 5, 40)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_")]


def test_other_limits_and_empty_table(spark):
    ids, texts = lined()
    got = line_runs.drop_repeated_lines(frame(spark, texts, ids), least_docs=2, least_chars=3, batches=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(list(zip(ids, texts, strict=True)), 2, 3)
    assert line_runs.drop_repeated_lines(frame(spark, [])).count() == 0


def test_keys_are_in_one_run_and_compaction_merges(spark):
    runs = line_runs.LineRuns(spark, fan=2)
    try:
        for batch in range(5):
            rows = [(batch * 100 + k, k % (7 + batch), 1) for k in range(40)]
            runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long"))
        assert [len(level) for level in runs.levels] == [1, 0, 1]  # five runs: four compacted twice, one new
        keys = [tuple(r) for name in runs.runs() for r in spark.table(name).filter("fresh").select("h1", "h2").collect()]
        assert len(keys) == len(set(keys)) == 11
        want = defaultdict(list)
        for batch in range(5):
            for k in range(40):
                want[k % (7 + batch)].append(batch * 100 + k)
        assert sorted(tuple(r)[:4] for r in runs.totals().collect()) == sorted((h, 1, len(d), max(d)) for h, d in want.items())
    finally:
        runs.close()


def test_anti_join_and_compaction_do_not_shuffle_runs(spark):
    runs = line_runs.LineRuns(spark, fan=9)
    try:
        for batch in range(2):
            runs.add(spark.createDataFrame([(batch * 100 + k, k + batch, 1) for k in range(40)], "doc_id long, h1 long, h2 long"))
        plan = runs._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        runs.close()


def test_native(spark):
    done = line_runs.drop_repeated_lines(frame(spark, ["a"])).select(F.sha2("kept", 256))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
    assert done.first()[0] == hashlib.sha256(b"a").hexdigest()
