import random
import zlib

import numpy as np

from gateflow.llm import langid
from tests.llm.data import frame

SYLLABLES = {"aa": ["ka", "to", "mi"], "bb": ["xu", "pel", "dro"], "cc": ["éb", "ñu", "zö"]}


def prose(lang, seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_gradients_match_differences():
    net = langid.ByteGru(["a", "b", "c"], hidden=5)
    x = np.random.default_rng(0).integers(1, 256, (12, 6)).astype(np.uint8)
    x[9:, 2] = 0  # a shorter text
    y = np.array([0, 1, 2, 0, 1, 2])
    _, grads = net.gradients(x, y)
    for name in grads:
        w = net.weights[name]
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        old, loss = w[at], []
        for step in (1e-2, -1e-2):
            w[at] = old + step
            loss.append(net.gradients(x, y)[0])
        w[at] = old
        assert abs(grads[name][at] - (loss[0] - loss[1]) / 2e-2) < 2e-3


def test_windows_cover_whole_texts():
    net = langid.ByteGru(["a", "b"])
    texts = ["x" * n for n in (0, 1, 95, 96, 97, 500)] + ["yz" * 200]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    together = net.documents(data, bounds)
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        total = np.zeros(2)
        for at in range(0, len(raw), langid.WINDOW):
            total += net.positions(raw[at: at + langid.WINDOW][:, None])[:, :, 0].sum(axis=0)
        assert np.allclose(together[k], total / max(1, len(raw)), atol=1e-5)
    assert (together[0] == 0).all()


def test_held_out_accuracy_and_edges(spark):
    langs = [lang for lang in SYLLABLES for _ in range(120)]
    texts = [prose(lang, k) for k, lang in enumerate(langs)]
    odd = [None, "", "12 34 !!", "é", texts[0], "ka to " * 30_000]
    table = frame(spark, texts + odd, [*range(len(texts)), 9001, 9002, 9003, 9004, None, 9005], langs + [None] * 6)
    rows = langid.identify(table).collect()
    assert len(rows) == len(texts) + 6
    by = {r.doc_id: r for r in rows}
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [k for k in range(len(texts)) if by[k].held_out]
    assert np.mean([by[k].lang_pred == langs[k] for k in held]) > 0.97
    assert [by[k].lang_pred for k in (9001, 9002, 9003)] == ["und"] * 3
    assert by[9004].lang_pred in SYLLABLES and by[9005].lang_pred == "aa" and by[None].held_out is False


def test_nothing_to_learn_from(spark):
    assert {r.lang_pred for r in langid.identify(frame(spark, ["abc"], langs=[None])).collect()} == {"und"}
    assert langid.identify(frame(spark, ["x"]).limit(0)).count() == 0
