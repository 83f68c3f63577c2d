import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from gateflow.llm import packing
from tests.llm.data import awkward, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def placed(counts, capacity, groups=packing.GROUPS):
    """Every piece's place from the plan, with checks that sequences have no gaps or overlaps."""
    p = packing.plan(counts, capacity, groups)
    key, seqs = (p["size"] << 48) | p["rank"], defaultdict(list)
    for size, count in counts.items():
        rank = np.arange(count)
        at = np.searchsorted(key, (size << 48) | rank, "right") - 1
        assert (p["size"][at] == size).all()
        for q, o in zip((p["sequence"][at] + rank - p["rank"][at]).tolist(), p["offset"][at].tolist(), strict=True):
            seqs[q].append((o, size))
    for items in seqs.values():
        end = 0
        for offset, size in sorted(items):
            assert offset == end
            end += size
        assert end <= capacity
    return len(seqs)


def best_fit_decreasing(counts, capacity):
    rooms = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(capacity - size)
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_gapless(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 16, 64])
    counts = Counter(rng.choices(range(1, capacity + 1), k=rng.randint(1, 300)))
    placed(dict(counts), capacity)


@pytest.mark.parametrize("low,high", [(1, 2048), (500, 1100), (20, 700), (683, 683)])
def test_plan_needs_no_more_than_best_fit(low, high):
    rng = random.Random(low)
    counts = Counter(rng.randint(low, high) for _ in range(1500))
    assert placed(dict(counts), 2048) <= 1.01 * best_fit_decreasing(counts, 2048)


def test_documents_are_packed_whole(spark):
    from tokenizers import Tokenizer
    ids, texts = awkward()
    got = packing.pack_documents(frame(spark, texts, ids), PATH).collect()
    library, want = Tokenizer.from_file(PATH), Counter()
    for i, t in zip(ids, texts, strict=True):
        tokens = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(tokens), 2048)):
            part = tokens[at: at + 2048]
            want[i, k, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for items in seqs.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark, ["x"]).limit(0), PATH).count() == 0
