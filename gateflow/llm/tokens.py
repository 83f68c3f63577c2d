"""Token ids of texts by the tokenizers library, with words kept once they are encoded."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gateflow.llm.common import holds

HELD = 600_000    # words of each of the two generations that are kept
TOGETHER = 256    # new words that the library encodes as one text
LONGEST = 64      # characters; longer words are encoded but not kept
GATHERED = 1 << 16  # words of a batch whose ids are put together at once


class KeptParts:
    """Ids of texts as little-endian unsigned 32-bit bytes, put together from the ids of their parts.

    Parts are kept in two generations of bounded size; the older one is dropped when the younger is full.
    """

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def learn(self, parts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def known(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts; new ones are learned and kept."""
        if len(self.young) > HELD:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, parts))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = ids = old.get(parts[i])
                if ids is None:
                    missing.append(i)
                else:
                    young[parts[i]] = ids
        for i, ids in zip(missing, self.learn([parts[i] for i in missing]), strict=True):
            found[i] = ids
            if len(parts[i]) <= LONGEST:
                young[parts[i]] = ids
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t) if t else [] for t in texts]
        distinct = list(set().union(*split))
        ids = dict(zip(distinct, self.known(distinct), strict=True))
        return [b"".join(map(ids.__getitem__, parts)) for parts in split]


class KeptWords:
    """Words and their ids in Arrow arrays, found by their sorted hashes: about a third of what strings in a dict take."""

    def __init__(self):
        self.hashes, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def __len__(self) -> int:
        return len(self.rows)

    def find(self, hashes: np.ndarray, words: pa.Array) -> np.ndarray:
        """Row of each word, or -1. Of kept words with equal hashes the first one is found."""
        found = np.full(len(hashes), -1, np.int64)
        if len(self):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
            met = np.flatnonzero(self.hashes[at] == hashes)
            rows = self.rows[at[met]]
            same = pc.equal(self.words.take(pa.array(rows)), words.take(pa.array(met))).to_numpy(zero_copy_only=False)
            found[met[same]] = rows[same]
        return found

    def add(self, hashes: np.ndarray, words: pa.Array, ids: pa.Array) -> None:
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.rows = np.insert(self.rows, at, order + len(self))
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.words = pa.concat_arrays([self.words, words])
        self.ids = pa.concat_arrays([self.ids, ids.cast(pa.binary())])


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words))


class WordEncoder:
    """For tokenizers whose tokens never reach across white space.

    Normalisation, special strings and merges of such a tokenizer stay inside the words between blanks or line ends,
    so the ids of a text are those of its words in turn; the library encodes every distinct word. Words are kept in two
    generations of bounded size; the older one is dropped when the younger is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.newer, self.older = KeptWords(), KeptWords()

    def known(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words as large binaries; new ones are learned and kept."""
        if len(self.newer) > HELD:
            self.older, self.newer = self.newer, KeptWords()
        texts = words.to_numpy(zero_copy_only=False).tolist()
        hashes = word_hashes(texts)
        rows = self.newer.find(hashes, words)
        held, rest = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        before = self.older.find(hashes[rest], words.take(pa.array(rest)))
        again, missing = rest[before >= 0], rest[before < 0]
        learned = self.learn([texts[i] for i in missing])
        order = np.concatenate([held, again, missing])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = pa.concat_arrays([self.newer.ids.take(pa.array(rows[held])).cast(pa.large_binary()),
                                self.older.ids.take(pa.array(before[before >= 0])).cast(pa.large_binary()),
                                pa.array(learned, pa.large_binary())]).take(pa.array(place))
        kept = np.concatenate([again, np.array([i for i in missing if len(texts[i]) <= LONGEST], np.int64)])
        self.newer.add(hashes[kept], words.take(pa.array(kept)), ids.take(pa.array(kept)))
        return ids

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text; Arrow splits the texts and numbers their distinct words, each of which is looked up once."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ids = self.known(words.dictionary)
        pool = np.frombuffer(ids.buffers()[2] or b"", np.uint32)
        upto = np.frombuffer(ids.buffers()[1] or bytes(8), np.int64)[: len(ids) + 1] // 4
        starts, sizes, of = upto[:-1], np.diff(upto), words.indices.to_numpy()
        parts = []
        for at in range(0, len(of), GATHERED):
            some = of[at: at + GATHERED]
            n = sizes[some]
            upto = np.cumsum(n)
            parts.append(pool[np.repeat(starts[some] - upto + n, n) + np.arange(upto[-1])].tobytes())
        flat = b"".join(parts)
        bounds = np.r_[0, np.cumsum(pc.list_value_length(split).fill_null(0).to_numpy())]
        upto = (4 * np.r_[0, np.cumsum(sizes[of])][bounds]).tolist()
        return [flat[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]

    def learn(self, parts: list[str]) -> list[bytes]:
        """Ids of words, which go to the library as texts of TOGETHER words; the offsets of the tokens tell the word."""
        groups = [parts[at: at + TOGETHER] for at in range(0, len(parts), TOGETHER)]
        out: list[bytes] = []
        for words, found in zip(groups, self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
            of = np.searchsorted(starts, [at for at, _ in found.offsets], "right")
            upto = 4 * np.searchsorted(of, np.arange(1, len(words) + 2))
            ids = array("I", found.ids).tobytes()
            out += [ids[x:y] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        return out


_encoders: dict = {}
holds("words", _encoders.clear)


def encoder(kind: type[KeptParts] | type[WordEncoder], path: str):
    """The encoder of this Python process for a tokenizer file."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]


def word_encoder(path: str) -> WordEncoder:
    return encoder(WordEncoder, path)
