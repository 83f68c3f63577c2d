import itertools
import random
import zlib

from gateflow.llm import toxicity as tox
from tests.llm.data import frame, words


def label(symbols):
    """What the machine must hold after a clause, by plain rules."""
    negated = plain_insult = plain_threat = False
    reach = 0
    for s in symbols:
        if s == tox.NEGATION:
            reach = tox.NEGATION_REACH
            continue
        if s in (tox.REPORT, tox.QUOTE):
            s = tox.OTHER
        if reach and s in (tox.INSULT, tox.THREAT):
            negated, reach = True, 0
            continue
        reach = max(0, reach - 1)
        plain_insult |= s == tox.INSULT
        plain_threat |= s == tox.THREAT
    return any(s in (tox.REPORT, tox.QUOTE) for s in symbols), negated, tox.TARGET in symbols, plain_insult, plain_threat


def test_composition_equals_rules():
    machine = tox.grammar()
    for n in range(5):
        for symbols in itertools.product(range(7), repeat=n):
            state = 0
            for s in symbols:
                state = machine.step[state][s][0]
            reported, _, *rest = machine.label[state]
            assert (reported, *rest) == label(symbols), symbols


def test_clauses_decide():
    scorer = tox.Scorer({"idiot": 1.0}, {"lowei": 1.0})
    assert scorer.score("You are an idiot.") > 0.9 and scorer.score("So ein loweichen!") > tox.THRESHOLD
    assert scorer.score("You are an idiot.") > scorer.score("They said: \"idiot\".") > scorer.score("A calm day.")
    assert scorer.score("You are an idiot.") > scorer.score("You are not an idiot.")
    assert scorer.score("They will kill you.") > scorer.score("We kill time.") == scorer.score("A calm day.")
    assert scorer.score(None) == scorer.score("") == scorer.score("A calm day.")


def test_learned_scores_on_held_out_rows(spark):
    rng = random.Random(4)
    texts, marks = [], []
    for k in range(400):
        toxic = k % 5 == 0
        text = words(k, 60, 900).split()
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(["blarg", "grunkel" + rng.choice("abcdef"), "idiot"]))
        texts.append(" ".join(text))
        marks.append(int(toxic))
    odd = [None, "", "idiot " * 40_000, texts[0]]
    docs = frame(spark, texts + odd, [*range(400), 900, 901, 902, None])
    labels = spark.createDataFrame([*zip(range(400), [1] * 400, marks, strict=True), (0, 1, 1), (None, 1, 1), (901, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tox.toxicity(docs, labels).collect()}
    assert len(got) == 404
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out for k in held)
    assert sum(got[k].predicted != marks[k] for k in held) <= 2
    assert got[900].predicted == got[901].predicted == 0 and got[902].predicted == 1


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in tox.toxicity(frame(spark, ["You idiot.", "Good day."]), none).collect()}
    assert got == {0: 1, 1: 0}
    assert tox.toxicity(frame(spark, ["x"]).limit(0), none).count() == 0


def test_capped_class_keeps_the_true_ratio(spark):
    """Only the clean class meets its cap: lexicon, intercept and scores stay those of all labelled rows."""
    texts, marks = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        j = k // 5 if toxic else k - k // 5 - 1
        extra = ["blarg"] * (j % 2 == 0) + ["greyish"] * (j % 10 < 6) if toxic else ["greyish"] * (j % 10 == 0)
        texts.append(" ".join([words(k, 20, 900), *extra]))
        marks.append(int(toxic))
    docs = frame(spark, texts).select("doc_id", "text")
    labels = spark.createDataFrame([(k, 1, m) for k, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    whole, capped = tox.train(docs, labels), tox.train(docs, labels, {1: 6_000, 0: 150})
    for scorer in (whole, capped):
        assert "blarg" in scorer.words
        assert "greyish" not in scorer.words  # 3 of 5 of its documents are toxic, in the capped sample 6 of 7
    assert abs(capped.bias - whole.bias) < 0.3  # the unweighted sample adds log(6) to it
    assert abs(capped.score("A calm day.") - whole.score("A calm day.")) < 0.03
