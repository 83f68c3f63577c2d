import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from gateflow.llm import ngram_join
from tests.llm.data import awkward, frame, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k: k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(ids, texts, width=4, percent=85):
    sets, up = [shingles(t, width) for t in texts], {i: i for i in ids if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (ids[a], ids[b]) and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(ids[a]), root(ids[b])
                up[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(root(i)) if i is not None else "None") for i, s in zip(ids, sets, strict=True))


def family():
    """Chains of edits with likenesses around the threshold, a large group of near copies, and a passage many share."""
    rng, texts = random.Random(7), []
    passage = words(99, 60)
    for k in range(8):
        text = words(200 + k, 150).split()
        for _ in range(12):
            texts.append(" ".join(text))
            for _ in range(rng.choice([1, 2, 3, 4])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    base = words(300, 100).split()
    for _ in range(60):
        text = list(base)
        text[rng.randrange(100)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    texts += [passage + " " + words(400 + k, 20) for k in range(30)]
    return texts


@pytest.mark.parametrize("block", [400_000, 1_500])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)  # small blocks: leaders and pairs of blocks
    ids, texts = awkward()
    more = family()
    texts, ids = texts + more, ids + [1000 + 7 * k for k in range(len(more))]
    got = ngram_join.jaccard_components(frame(spark, texts, ids)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(ids, texts)


def test_divide_skip_equals_counting():
    rng, j = np.random.default_rng(3), Fraction(85, 100)
    base = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    sets = []
    for _ in range(80):
        s = base.copy()
        s[rng.integers(0, len(s), rng.integers(0, 9))] = rng.integers(0, 2**63)
        sets.append(np.unique(s[: rng.integers(20, len(s) + 1)]))
    index = ngram_join.DivideSkip(sets)
    for q in [*sets, np.zeros(0, np.uint64), rng.integers(0, 2**63, 9).astype(np.uint64)]:
        q = np.unique(q)
        want = [r for r, s in enumerate(sets) if len(q) and 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))]
        assert list(index.search(q, j)) == want


def test_shingles_end_with_documents():
    got = ngram_join.shingle_sets(pa.array(["a b c d", "e f", None, "", "A B\x0cC D"]), 4)
    assert [len(s) for s in got] == [1, 1, 0, 0, 1] and got[0][0] == got[4][0]


def test_empty_table(spark):
    assert ngram_join.jaccard_components(frame(spark, ["x"]).limit(0)).count() == 0
