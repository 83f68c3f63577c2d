import hashlib
import re

from gateflow.llm import iblt, queries
from tests.llm.data import awkward, frame, words

UNIT = re.compile(r"[^ \t\n\x0b\f\r][^\n]{0,111}[^ \t\n\x0b\f\r]*")


def test_fingerprints_equal_brute_force(spark):
    ids, texts = awkward()
    got = iblt.version_fingerprints(frame(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want, prints = [], {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        a, e, n = (set(UNIT.findall(x)) for x in (t, edited, after))
        near = [1.0 if not a | b else len(a & b) / len(a | b) for b in (e, n)]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), *(round(x, 9) for x in near)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    for r in got:  # equal texts, equal fingerprints
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert prints[30, len(texts[0])] == prints[40, len(texts[0])] and len(prints[30, len(texts[0])]) == 1


def test_peeling_recovers_and_retries(spark, monkeypatch):
    monkeypatch.setattr(iblt, "BASE_WIDTH", 1)
    monkeypatch.setattr(iblt, "ROUNDS", 3)  # too few passes: larger sketches must finish the work
    pairs = spark.createDataFrame([(k, list(range(k, k + 40)), list(range(k + 3, k + 40 + k))) for k in range(30)], "k int, left array<long>, right array<long>")
    got = {}
    for r in iblt.differences(pairs, ["k"]).collect():
        got.setdefault((r.k, r.side), set()).add(r.digest)
    for k in range(30):
        left, right = set(range(k, k + 40)), set(range(k + 3, k + 40 + k))
        assert got.get((k, 1), set()) == left - right and got.get((k, -1), set()) == right - left


def test_empty_table_and_null_ids(spark):
    assert iblt.version_fingerprints(frame(spark, ["x"]).limit(0)).count() == 0
    rows = iblt.version_fingerprints(frame(spark, ["One. Two.", "Three."], [None, None])).collect()
    assert {r.edited_sha256 for r in rows} == {hashlib.sha256(x).hexdigest() for x in (b"One. Thre", b"ThrOne")}


def test_main_path_is_native(spark):
    plan = iblt.version_fingerprints(frame(spark, ["a b", "c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_digests_are_made_after_the_shuffle(spark, monkeypatch):
    """Only ids and texts travel: digests do not compress, and the shuffle is most of the disk."""
    plans, dealing = [], iblt.with_next

    def seen(*args, **options):
        out = dealing(*args, **options)
        plans.append(out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return out

    monkeypatch.setattr(iblt, "with_next", seen)
    assert iblt.version_fingerprints(frame(spark, ["One. Two.", "Three."], [7, 7])).count() == 2
    shuffled = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plans[0])
    assert [re.sub(r"#\d+L?", "", x) for x in shuffled] == ["doc_id, text, guest, dest"]


SENTENCE_UNIT = re.compile(r"[^ \t\n\x0b\f\r][^\n.!?]{0,95}[^ \t\n\x0b\f\r.!?]*[.!?]*")


def test_query_cuts_meet_again_after_an_inserted_word(spark, tmp_path):
    sentences = [words(600 + k, 14) + "." for k in range(12)]
    text = " ".join(sentences)
    edited = "inserted " + text
    frame(spark, [text, edited, "One. Two!\nThree", None]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op1_document_fingerprints"](spark, str(tmp_path)).collect()}
    texts = [text, edited, "One. Two!\nThree", ""]
    for i, t in enumerate(texts):
        a, b = (set(SENTENCE_UNIT.findall(x)) for x in (t, texts[(i - 1) % 4]))
        assert abs(got[i].near_next - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
    assert got[1].near_next > 0.8  # the next document is the same text without the inserted word
