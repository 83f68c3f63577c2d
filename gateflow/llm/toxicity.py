"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words become symbols (insult, threat, target, negation, report, quote mark, break, other). Transducers for each
phenomenon read the symbols of a clause; composed, they are one machine whose output at the end of a clause says which
pattern matched: an insult or a threat, aimed at a target or not, negated or not, reported or not. A document is scored
by the weights of its matched clauses, never by words alone. The insult lexicon (words and stems) and the weights of the
patterns are learned from labelled rows.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gateflow.llm.common import materialise, release, ship
from gateflow.llm.langid import held_out

# Seed words of the symbols, in English, German, French and Spanish.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns
dummkopf blödmann abschaum crétin imbécile ordure estúpido imbécil escoria basura""".split()
THREATS = """kill hurt destroy beat murder shoot stab töten umbringen schlagen tuer frapper matar golpear""".split()
TARGETS = """you your yours u ye he she they him them her these those du dich dir ihr euch sie tu toi te vous ils elles tú ti
vosotros usted ustedes ellos ellas""".split()
NEGATIONS = """not never no nobody isn't aren't don't doesn't won't wasn't cannot nicht kein keine nie niemals pas jamais
aucun nunca jamás tampoco""".split()
REPORTS = """said says say told called calls wrote quoted reported claimed alleged sagte schrieb nannte berichtete dit écrit
appelé dijo escribió llamó""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, BREAK = range(8)
NEGATION_REACH = 3  # words between a negation and what it turns round
STEMS = (4, 5, 6, 7)
SAMPLE = {1: 6_000, 0: 24_000}  # labelled documents of each kind that lexicon and weights are learned from
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;\n]|[\"“”«»„]")
_WORD = re.compile(r"[^\W_]+")


class Transducer:
    """Letter transducer: ``step[state][symbol]`` is the next state and the symbol passed on; ``label[state]`` what holds."""

    def __init__(self, step: list[list[tuple[int, int]]], label: list):
        self.step, self.label = step, label

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: ``other`` reads what this one writes; states that cannot be reached are left out."""
        number = {(0, 0): 0}
        todo, step, label = [(0, 0)], [], []
        for a, b in todo:
            row = []
            for symbol in range(8):
                a2, passed = self.step[a][symbol]
                b2, written = other.step[b][passed]
                if (a2, b2) not in number:
                    number[a2, b2] = len(todo)
                    todo.append((a2, b2))
                row.append((number[a2, b2], written))
            step.append(row)
            label.append((*self.label[a], *other.label[b]))
        return Transducer(step, label)


def _machine(states: int, rule, label) -> Transducer:
    return Transducer([[rule(s, x) for x in range(8)] for s in range(states)], [(label(s),) for s in range(states)])


def grammar() -> Transducer:
    """The composed machine. A state's label is (reported, negated, target, insult, threat) for the clause so far."""
    reported = _machine(2, lambda s, x: (1 if x in (REPORT, QUOTE) else s, OTHER if x in (REPORT, QUOTE) else x), lambda s: s == 1)

    # a negation writes itself once, in place of the insult or threat in its reach
    def negates(s, x):
        if x == NEGATION:
            return NEGATION_REACH, OTHER
        if s and x in (INSULT, THREAT):
            return 0, NEGATION
        return max(0, s - 1), x
    negation = _machine(NEGATION_REACH + 1, negates, lambda s: None)
    turned = _machine(2, lambda s, x: (1 if x == NEGATION else s, x), lambda s: s == 1)
    target = _machine(2, lambda s, x: (1 if x == TARGET else s, x), lambda s: s == 1)
    insult = _machine(2, lambda s, x: (1 if x == INSULT else s, x), lambda s: s == 1)
    threat = _machine(2, lambda s, x: (1 if x == THREAT else s, x), lambda s: s == 1)
    return reported @ negation @ turned @ target @ insult @ threat


def _pattern(label) -> int | None:
    """Number of the clause pattern of a machine label, None where nothing matched."""
    reported, _, negated, target, insult, threat = label
    if insult or threat:
        return (0 if insult else 4) + 2 * bool(target) + bool(reported)
    return 8 + bool(reported) if negated else None


PATTERNS = 10  # insult and threat, each with and without target and report; negated, with and without report
# Prior weights of the patterns, in their order, and of the length: a bare threat word weighs nothing until labels say so.
PRIOR = np.array([8.0, 6.0, 9.0, 6.0, 0.0, 0.0, 3.5, 2.0, 5.0, 3.5, 0.0])
CLEAR = 0.75  # share of toxic documents from which a word or stem counts as an insult


class Scorer:
    def __init__(self, words: dict[str, float], stems: dict[str, float], bias: float = -3.0, weights: np.ndarray | None = None):
        self.words, self.stems = words, stems
        self.bias, self.weights = bias, PRIOR.copy() if weights is None else weights
        self.symbols = {w: s for s, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}
        self.threats = frozenset(THREATS)
        machine = grammar()
        self.step = [[n for n, _ in row] for row in machine.step]
        self.kind = [_pattern(x) for x in machine.label]

    def insult(self, word: str) -> float:
        """Lexical weight of a word: its own entry, else that of its longest known stem, else 0."""
        found = self.words.get(word)
        if found is None:
            found = next((self.stems[word[:n]] for n in reversed(STEMS) if word[:n] in self.stems), 0.0)
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Per pattern: log(1 + lexical weight of all its clauses); last the logarithm of the length of the text if any matched.

        A longer text holds more words that only look like insults, which the weight of the length can balance.
        """
        out = np.zeros(PATTERNS + 1)
        text = (text or "").lower()
        vocabulary = set(_WORD.findall(text))
        insults = {w: x for w in vocabulary if (x := self.insult(w))}
        if not insults and self.threats.isdisjoint(vocabulary):
            return out
        state, weight = 0, 0.0
        for token in itertools.chain(_TOKEN.findall(text), "."):
            if token in ".!?;\n":
                if (k := self.kind[state]) is not None:
                    out[k] += weight
                state, weight = 0, 0.0
                continue
            if token in insults:
                symbol = INSULT
                weight += insults[token]
            else:
                symbol = QUOTE if token in "\"“”«»„" else self.symbols.get(token, OTHER)
                weight += symbol == THREAT
            state = self.step[state][symbol]
        if out.any():
            out[PATTERNS] = math.log1p(len(text) / 1000)
            out[:PATTERNS] = np.log1p(out[:PATTERNS])
        return out

    def score(self, text: str | None) -> float:
        x = self.bias + float(self.features(text) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def fit(self, x: np.ndarray, y: np.ndarray, counts: np.ndarray, strength: float = 1.0) -> Scorer:
        """Logistic regression on distinct feature rows with their counts, drawn to the prior (Newton steps)."""
        a = np.c_[np.ones(len(x)), x]
        prior = np.r_[-3.0, PRIOR]
        w = prior.copy()
        pull = np.r_[0.05, np.full(PATTERNS + 1, strength)]
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (counts * (p - y)) + pull * (w - prior)
            h = (a * (counts * p * (1 - p))[:, None]).T @ a + np.diag(pull)
            step = np.linalg.solve(h, g)
            w -= np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        self.bias, self.weights = float(w[0]), w[1:]
        return self


def _sample(docs: DataFrame, labels: DataFrame, sample: dict[int, int]) -> tuple[DataFrame, dict[int, float]]:
    """Labelled documents that are not held out: of each label those with the smallest hashes, up to its bound.

    Also for each label how many labelled ids one id of the sample stands for.
    """
    known = labels.filter(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    top = known.withColumn("place", F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")))
    top = top.filter(" OR ".join(f"(toxic = {k} AND place <= {n})" for k, n in sample.items())).select("doc_id", "toxic")
    stands_for = {r.toxic: max(1.0, r["count"] / sample[r.toxic]) for r in known.groupBy("toxic").count().collect()}
    # the sample has at most sum(sample) ids, whatever the size of the tables
    return docs.join(F.broadcast(top), "doc_id").select("toxic", "text"), stands_for


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Scorer:
    """Lexicon and pattern weights from a bounded sample of ``labels`` (doc_id, toxic) joined to ``docs`` (doc_id, text).

    A word or stem is an insult if its documents are toxic so often that chance (a Chernoff bound over all candidates)
    is ruled out. Rows of a label that met its bound count for those left out, so rates, base and weights are those of
    all labelled rows. Without labelled rows the seed words and prior weights hold.
    """
    chosen_rows, stands_for = _sample(docs, labels, sample or SAMPLE)
    rows = materialise(chosen_rows, "toxicity-sample")
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    if not total.pos or total.pos == total.n:
        return Scorer({w: 1.0 for w in INSULTS}, {})
    # in all as many as the sample has rows: what it proves, against the prior too, does not grow with the rows left out
    scale = total.n / (stands_for[1] * total.pos + stands_for[0] * (total.n - total.pos))
    weight = {k: float(w * scale) for k, w in stands_for.items()}
    base = weight[1] * total.pos / total.n
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).filter("word <> ''")
    # counts of documents; stems count a document once for each of its words, which is close enough for a lexicon
    terms = words.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).select(
        F.explode(F.array(F.struct(F.lit(0).alias("size"), F.col("word").alias("term")), *[
            F.struct(F.lit(k).alias("size"), F.when(F.length("word") > k, F.substring("word", 1, k)).alias("term")) for k in STEMS])).alias("t"),
        "n", "pos").filter("t.term IS NOT NULL").groupBy("t.size", "t.term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    candidates = materialise(terms.filter("pos >= 3"), "toxicity-terms")
    tested = max(1, candidates.count())
    rate = weight[1] * F.col("pos") / (weight[1] * F.col("pos") + weight[0] * (F.col("n") - F.col("pos")))
    # chance is judged on the rows drawn: a term that says nothing about the label has the sample's own share in them
    drawn, share = F.col("pos") / F.col("n"), total.pos / total.n
    above = F.when(F.col("pos") == F.col("n"), F.lit(0.0)).otherwise((1 - drawn) * F.log((1 - drawn) / (1 - share)))
    chosen = candidates.filter(rate > max(CLEAR, base)).filter(
        F.col("n") * (drawn * F.log(drawn / share) + above) > math.log(10 * tested)).select("size", "term", rate.alias("rate")).collect()
    # a word that half the time stands in clean documents says far less than one that never does
    lexicon = {r.term: float(r.rate) ** 4 for r in chosen if r.size == 0} | {w: 1.0 for w in INSULTS}
    scorer = Scorer(lexicon, {r.term: float(r.rate) ** 4 for r in chosen if r.size})

    ship(docs.sparkSession)
    seen = (rows.select("toxic", _features(scorer, F.col("text")).alias("f")).groupBy("toxic", "f").count().collect())
    return scorer.fit(np.array([r.f for r in seen]), np.array([float(r.toxic) for r in seen]), np.array([r["count"] * weight[r.toxic] for r in seen]))


def _features(scorer: Scorer, text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([np.round(scorer.features(t.as_py()), 1).tolist() for t in texts], pa.list_(pa.float64()))
    return run(text)


def score_column(scorer: Scorer, text: Column) -> Column:
    """Score from 0 to 1 of a text column; a null or empty text has the score of a text without matched clauses."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())
        release()
        return out
    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``; ``labels`` has (doc_id, toxic).

    Null and empty texts have the score of a text without matched clauses. Equal texts have equal scores, rows with equal
    ids are scored apart, a null id is not held out and never learned from. Labels other than 0 and 1 are left out; without labels
    the seed words and prior weights hold. Other columns are left alone; an empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scorer = train(plain, labels)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(scorer, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
