import hashlib
import tracemalloc
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gateflow.llm import orc_tokens, pieces, token_counts, tokens
from gateflow.session import run_folder
from tests.llm.data import awkward, frame, words

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_words_in_turn_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 5)  # generations change all the time
    monkeypatch.setattr(tokens, "LONGEST", 8)
    library, encoder = Tokenizer.from_file(WORD), tokens.WordEncoder(WORD)
    texts = [t for t in awkward()[1] if t is None or len(t) < 5000] + ["İΣ ΑΣ́ é  \x1c x y z", "a<|endoftext|>b <|startoftext|>", "it's I'LL\r\n1234"]
    for _ in range(2):
        for some in (texts, texts[::-1], [texts[0]]):
            want = [array("I", library.encode(t or "", add_special_tokens=False).ids).tobytes() for t in some]
            assert encoder.encode(some) == want


def test_a_batch_looks_each_distinct_word_up_once():
    """The store is far larger than a processor's caches; looking up every occurrence took a quarter of op8's Python time."""
    class Counted(dict):
        asked = 0

        def get(self, key, *other):
            Counted.asked += 1
            return super().get(key, *other)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    texts = pa.array(["skipped", words(1, 400, 20), None, "", "\n " + words(2, 400, 20) + " \n", "x" * 100 + " é\x00 a<|endoftext|>b"]).slice(1)
    library, encoder = Tokenizer.from_file(WORD), tokens.WordEncoder(WORD)
    encoder.young = Counted()
    want = [array("I", library.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts.to_pylist()]
    for _ in range(2):
        Counted.asked = 0
        assert encoder.encode(texts) == want
        assert Counted.asked <= len({w for t in texts.to_pylist() if t for w in t.replace("\n", " ").split(" ")} | {""})
    assert encoder.encode(texts.slice(0, 0)) == [] and encoder.encode([None]) == [b""]


def test_kept_words_take_little_memory_and_are_found_in_both_generations(monkeypatch):
    """Strings and bytes in two dicts took about 150 bytes a word: four workers with full stores broke an executor's limit."""
    monkeypatch.setattr(tokens, "HELD", 20_000)
    encoder, asked = tokens.WordEncoder(WORD), []
    monkeypatch.setattr(encoder, "learn", lambda parts: asked.append(len(parts)) or [b"\1\0\0\0\2\0\0\0"] * len(parts))
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    for k in range(3):
        encoder.encode([" ".join(f"{i:08x}" for i in range(10_500 * k, 10_500 * (k + 1)))])
    taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert asked == [10_500] * 3 and taken < 60 * 31_500
    encoder.encode([" ".join(f"{i:08x}" for i in range(0, 31_500, 7))])
    assert sum(asked) == 31_500


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "word_hashes", lambda some: np.array([len(w) % 2 for w in some], np.int64))
    library, encoder = Tokenizer.from_file(WORD), tokens.WordEncoder(WORD)
    texts = [words(k, 200, 100) + " é\x00 a<|endoftext|>b  \n" for k in range(3)]
    want = [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    for _ in range(2):
        assert [encoder.encode([t])[0] for t in texts] == want


def lattice(v, text):
    """Best path over all pieces, without windows."""
    best = [(0.0, 0, None)] + [None] * len(text)
    for i in range(len(text)):
        base = best[i][0]
        for n in range(1, v.longest + 1):
            piece = v.pieces.get(text[i: i + n]) if i + n <= len(text) else None
            for end, score, p in ([(i + n, base + piece[1], piece[0])] if piece else []) + ([(i + 1, base + v.unknown, None)] if n == 1 else []):
                if best[end] is None or score > best[end][0]:
                    best[end] = (score, i, p)
    out, at = [], len(text)
    while at:
        _, before, p = best[at]
        out += [p] if p is not None else [v.bytes[b] for b in reversed(text[before:at].encode())]
        at = before
    return out[::-1]


def test_streaming_viterbi_equals_the_lattice():
    v, encoder = pieces.Vocabulary.load(PIECE), pieces.PieceEncoder(PIECE)
    for t in ["", " ", "  a  b\n c\td", "日本ａ x", "\n\n", "a" * 300 + "é" * 200, "▁a▁ b", "The quick brown fox", words(3, 200), "x\x00y"]:
        marked = "▁" + t.replace(" ", "▁") if t else ""
        want = lattice(v, marked)
        assert pieces.segment(v, marked) == want
        assert np.frombuffer(encoder.encode([t])[0], np.uint32).tolist() == want
        assert pieces.decode(v, want) == t.replace("▁", " ")


def test_ids_are_final_early():
    v = pieces.Vocabulary({"a": (0, -1.0), "b": (1, -1.0), "ab": (2, -1.5)}, list(range(100, 356)))
    search, longest = pieces.StreamingViterbi(v), 0
    out = []
    for _ in range(5000):
        out += search.feed("ab")
        longest = max(longest, len(search.window))
    out += search.finish()
    assert out == [2] * 5000 and longest <= 8


def test_pieces_round_trip(spark):
    ids, texts = awkward()
    long_ = {(r.doc_id, r.decoded) for r in pieces.encode_decode(frame(spark, texts, ids), PIECE).collect()}
    assert long_ == {(i, (t or "").replace("▁", " ")) for i, t in zip(ids, texts, strict=True)}
    short = Counter((r.doc_id, r.decoded_sha256) for r in pieces.digests(frame(spark, texts, ids), PIECE).collect())
    assert short == Counter((i, hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()) for i, t in zip(ids, texts, strict=True))


@pytest.mark.parametrize("path", [PIECE, WORD])
def test_counts_and_cache(spark, path, monkeypatch):
    from sentencepiece import SentencePieceProcessor
    ids, texts = awkward()
    if path == PIECE:
        model = SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = Counter((i, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for i, t in zip(ids, texts, strict=True))
    cache = run_folder(spark, "counts")
    docs = frame(spark, texts, ids)
    for _ in range(2):
        assert Counter(tuple(r) for r in token_counts.count_tokens(docs, cache, path).collect()) == want
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})  # each content once, nothing the second time
    monkeypatch.setattr(token_counts, "tokenizer_version", lambda p: "next")
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, cache, path).collect()) == want
    assert spark.read.parquet(cache).count() == 2 * len({t or "" for t in texts})
    assert token_counts.count_tokens(docs.limit(0), run_folder(spark, "counts"), path).count() == 0


def test_orc_files_round_trip(spark):
    library = Tokenizer.from_file(WORD)
    ids, texts = awkward()
    ids, texts = ids + list(range(100, 160)), texts + [words(k, 30) for k in range(60)]
    folder = run_folder(spark, "orc")
    orc_tokens.write_tokens(frame(spark, texts, ids), folder, WORD, files=4)
    rows = orc_tokens.read_tokens(spark, folder)
    tokens_ = {}
    for i, t in zip(ids, texts, strict=True):
        tokens_.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [1])
    found = {}
    for r in rows.collect():
        found.setdefault(r.doc_id, []).append(list(r.ids))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in tokens_.items()}
    got = orc_tokens.token_offsets(rows).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (i, len(x), zlib.crc32(array("I", x).tobytes())) for i, v in tokens_.items() for x in v)
    end = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))
    some = orc_tokens.read_tokens(spark, folder, 110, 119)
    assert {r.doc_id for r in some.collect()} == set(range(110, 120))
    assert "GreaterThanOrEqual(doc_id,110)" in some._jdf.queryExecution().executedPlan().toString()
    empty = run_folder(spark, "orc")
    orc_tokens.write_tokens(frame(spark, ["x"]).limit(0), empty, WORD)
    assert orc_tokens.token_offsets(orc_tokens.read_tokens(spark, empty)).count() == 0
