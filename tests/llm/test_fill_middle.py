import hashlib
from collections import Counter

from gateflow.llm import fill_middle
from tests.llm.data import awkward, frame, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    """(row of ``digests``, output) by the rule itself on whole texts."""
    text = text or ""
    n, drawn = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(drawn[k: k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, a, b - a, sha(output), sha(text)), output


def cases():
    ids, texts = awkward()
    more = ["a<P>b", "x <S", "<M>", "<S>" * 3, "><", "P>", "<", words(9, 700), "\U0001f600" * 50, *["same row"] * 5]
    return ids + [100, 101, 102, 103, 104, 105, 106, 107, 108, *[109] * 5], texts + more


def test_digests_equal_brute_force(spark):
    ids, texts = cases()
    ids, texts = ids + list(range(1000, 1200)), texts + [f"{words(k, k % 40)}<" for k in range(200)]
    want = Counter(brute(i, t)[0] for i, t in zip(ids, texts, strict=True))
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    for piece in (16_384, 7, 1):
        few = zip(ids, texts, strict=True) if piece > 1 else [(i, t) for i, t in zip(ids, texts, strict=True) if len(t or "") < 3000]
        rows = list(few)
        got = fill_middle.digests(frame(spark, [t for _, t in rows], [i for i, _ in rows]), piece=piece)
        assert Counter(tuple(r) for r in got.collect()) == Counter(brute(i, t)[0] for i, t in rows)


def test_output_texts(spark):
    ids, texts = cases()
    got = fill_middle.fill_in_middle(frame(spark, texts, ids), piece=50).select("doc_id", "output").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, brute(i, t)[1]) for i, t in zip(ids, texts, strict=True))


def test_units_are_never_cut(spark):
    texts = [words(k, 30) + "\n tail" for k in range(60)] + ["", None, "   "]
    got = fill_middle.fill_in_middle(frame(spark, texts), unit=r"\S+\s*").collect()
    for r in got:
        text = texts[r["doc_id"]] or ""
        if r["form"] == "plain":
            assert r["output"] == text
            continue
        a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
        assert {a, b} <= set(fill_middle.cuts(text, r"\S+\s*"))
        assert r["output"] in (f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    assert len(got) == len(texts)


def test_one_exchange_and_two_sorts(spark):
    plan = fill_middle.digests(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def test_empty_table(spark):
    assert fill_middle.digests(frame(spark, [])).count() == fill_middle.fill_in_middle(frame(spark, [])).count() == 0
