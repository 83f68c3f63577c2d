import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from gateflow.llm import source_audit
from gateflow.llm.common import text_bytes
from gateflow.llm.pointer_sort import Shard
from tests.llm.data import awkward

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(rows, least=10, top=10):
    counts, docs, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        for t in terms(text):
            counts[*key, t] += 1
        docs[key[0]].update(set(terms(text)))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        in_lang = {t: sum(counts[lang, s, t] for s in sources) for t in kept}

        def shares(of):
            n = sum(of.values())
            return {t: 1 + 10**9 * (of[t] + 2) // (n + 2 * len(kept)) for t in kept}
        p = {s: shares({t: counts[lang, s, t] for t in kept}) for s in sources}
        q = shares(in_lang)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            told = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", told)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "alphabet", "alphabetical", "alphabetically", "été", "Été", "日本語", "x", "xy", "internationalisation", "internationalise",
                  *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) + rng.choice(["", ".", "3d_Q", "\n"]), rng.choice(["en", "de", None, ""]),
             rng.choice(["a", "b", "c", None, "é", "Z"])) for _ in range(300)]
    rows += [(t, "en", "a") for t in awkward()[1]] + [("", "fr", "only"), (None, "it", "u"), ("rare word", "it", "v"), ("12 34", "it", None), ("q" * 5000 + " " + "q" * 5001, "en", "b")]
    return rows * 2


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, 1, "x", 2, "t") for k, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n long, term string, tile int, part string")


@pytest.mark.parametrize("options", [{}, {"tile": 2, "block": 7}, {"least_docs": 1, "top": 3, "tile": 3}, {"least_docs": 10_000}])
def test_divergence_equals_brute_force(spark, options):
    rows = corpus()
    got = source_audit.source_divergence(frame(spark, rows), **options)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["lang string", "source string", "part string", "item string", "value bigint", "rank int"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, options.get("least_docs", 10), options.get("top", 10))


def test_empty_table(spark):
    assert source_audit.source_divergence(frame(spark, [])).count() == 0


def test_shards_and_merges_change_nothing(spark, monkeypatch):
    rows = corpus()
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["t", "l", "s"])
    whole = {tuple(r.values()) for b in source_audit._count_batches([batch]) for r in b.to_pylist()}
    monkeypatch.setattr(source_audit, "SHARD", 500)
    monkeypatch.setattr(source_audit, "HELD", 40)
    parts = Counter()
    for b in source_audit._count_batches([batch]):
        for r in b.to_pylist():
            parts[r["lang"], r["source"], r["term"], "n"] += r["count"]
            parts[r["lang"], r["source"], r["term"], "d"] += r["docs"]
    assert {(k[0], k[1], k[2], v, parts[*k[:3], "d"]) for k, v in parts.items() if k[3] == "n"} == whole


def test_pointers_are_sorted_as_bytes():
    rng = random.Random(8)
    alphabet = ["a", "B", "b", "é", "日", "zz", "z" * 9, "z" * 16]
    texts = [" ".join("".join(rng.choices(alphabet, k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, "", "end", "end"]
    shard = Shard(*text_bytes(pa.array(texts)))
    order, run = shard.sort()
    found = shard.words(order).to_pylist()
    assert found == sorted((t for text in texts for t in terms(text)), key=str.encode)
    assert [int(a != b) for a, b in zip(found, found[1:], strict=False)] == np.diff(run).tolist()


def test_blocks_in_a_fresh_worker(monkeypatch):
    """A worker whose first task is a block has imported pyarrow alone, of which compute is no part."""
    monkeypatch.delattr(pa, "compute")
    rows = [("en", s, 0, t, p, 0, 0, 0) for s, t, p in (("a", None, 2), ("b", None, 3), ("a", "x", 10))]
    names = ["lang", "source", "tile", "term", "p", "block", "tile_a", "tile_b"]
    found = source_audit.block_pairs(pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=names))
    assert found.to_pylist() == [{"lang": "en", "source": s, "item": o, "value": 3, "terms": 1} for s, o in ("ab", "ba")]
