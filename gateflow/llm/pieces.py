"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi search.

Characters arrive one by one. Only the positions that a piece can still start from are open, and as soon as the best paths
to all of them come from one boundary, the ids up to it are final and leave the window. No piece of the vocabulary holds a
space mark behind another character, so all paths meet before every space mark and the parts between are independent;
short ones are kept once they are encoded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.common import arrow_map
from gateflow.llm.tokens import KeptParts, encoder

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # below the least score of the vocabulary, as in the published library


class Vocabulary:
    """Pieces with their scores, and the ids of single bytes for characters that no piece covers."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: list[int]):
        self.pieces, self.bytes = pieces, bytes_
        self.longest = max(map(len, pieces), default=1)
        self.prefixes = {p[:n] for p in pieces for n in range(1, len(p) + 1)}
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.text = {i: p for p, (i, _) in pieces.items()}
        self.byte = {i: b for b, i in enumerate(bytes_)}
        self.parted = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.lines = not any("\n" in p for p in pieces)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        usual = [i for i in range(len(model)) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        return cls({model.id_to_piece(i): (i, model.get_score(i)) for i in usual}, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class StreamingViterbi:
    """Best segmentation of a stream of characters; ``feed`` yields ids as soon as they are final, ``finish`` the rest.

    Among equal scores the path whose last piece is longest wins.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.start = 0          # position of the window's first character; everything before it is final
        self.window = ""
        self.best = [0.0]       # score of the best path to each boundary of the window
        self.back: list[tuple[int, int | None]] = [(0, None)]  # where it comes from, and the id (None: bytes)
        self.reach = 0          # boundaries up to here have all their candidates

    def _extend(self, upto: int) -> None:
        """Use every boundary below ``upto`` as the start of pieces."""
        v, window = self.v, self.window
        for at in range(self.reach, upto):
            base, n = self.best[at], at + 1
            if self.best[n] < base + v.unknown:
                self.best[n], self.back[n] = base + v.unknown, (at, None)
            part = window[at]
            while part in v.prefixes:
                found = v.pieces.get(part)
                if found is not None and base + found[1] > self.best[n]:
                    self.best[n], self.back[n] = base + found[1], (at, found[0])
                if n == len(window):
                    break
                n += 1
                part = window[at:n]
        self.reach = upto

    def _emit(self, upto: int) -> list[int]:
        """Ids of the best path to boundary ``upto``, which becomes the start of the window."""
        out: list[int] = []
        at = upto
        while at:
            before, piece = self.back[at]
            out += [piece] if piece is not None else [self.v.bytes[b] for b in reversed(self.window[before:at].encode())]
            at = before
        score = self.best[upto]
        self.best = [s - score for s in self.best[upto:]]
        self.back = [(b - upto, p) for b, p in self.back[upto:]]
        self.window = self.window[upto:]
        self.start += upto
        self.reach -= upto
        return out[::-1]

    def feed(self, characters: str) -> Iterator[int]:
        longest = self.v.longest
        for at in range(0, len(characters), longest):
            some = characters[at: at + longest]
            self.window += some
            self.best += [float("-inf")] * len(some)
            self.back += [(0, None)] * len(some)
            ready = len(self.window) - longest  # pieces from here on may still grow
            if ready <= self.reach:
                continue
            self._extend(ready)
            # boundaries that the future can continue from: the ready one and all beyond it that are already reached
            open_ = {n for n in range(ready, len(self.window) + 1) if self.best[n] > float("-inf")}
            while len(open_) > 1:
                last = max(open_)
                open_.remove(last)
                open_.add(self.back[last][0])
            meeting = open_.pop()
            if meeting:
                yield from self._emit(meeting)

    def finish(self) -> list[int]:
        self._extend(len(self.window))
        return self._emit(len(self.window))


def segment(vocabulary: Vocabulary, text: str) -> list[int]:
    search = StreamingViterbi(vocabulary)
    return [*search.feed(text), *search.finish()]


class PieceEncoder(KeptParts):
    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = Vocabulary.load(path)
        self.part = (re.compile(f"{SPACE}+[^{SPACE}\n]*|\n+[^{SPACE}\n]*" if self.vocabulary.lines else f"{SPACE}+[^{SPACE}]*")
                     if self.vocabulary.parted else None)

    def split(self, text: str) -> list[str]:
        text = SPACE + text.replace(" ", SPACE)
        return self.part.findall(text) if self.part else [text]

    def learn(self, parts: list[str]) -> list[bytes]:
        return [array("I", segment(self.vocabulary, p)).tobytes() for p in parts]


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """Text of ids: space marks become blanks, the blank before the text goes, runs of byte ids are UTF-8."""
    out, pending = [], bytearray()
    for i in ids:
        b = vocabulary.byte.get(i)
        if b is not None:
            pending.append(b)
            continue
        if pending:
            out.append(pending.decode("utf-8", "replace"))
            pending.clear()
        out.append(vocabulary.text.get(i, ""))
    out.append(pending.decode("utf-8", "replace"))
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every row; a null or empty text has no ids and decodes to an empty text.

    ``decoded`` is the text, with any space mark U+2581 in it as a blank.
    """
    def run(batch):
        use = encoder(PieceEncoder, model)
        ids = [np.frombuffer(x, np.uint32).tolist() for x in use.encode(batch.column(1).to_pylist())]
        return {"doc_id": batch.column(0), "ids": ids, "decoded": [decode(use.vocabulary, x) for x in ids]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, ids array<int>, decoded string", rows=128, needs=("words",)).withColumnRenamed("doc_id", id_col)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, decoded_sha256): the same in short, without moving the ids out of Python."""
    def run(batch):
        use = encoder(PieceEncoder, model)
        out = {"doc_id": batch.column(0), "n_tokens": [], "ids_crc32": [], "decoded_sha256": []}
        for ids in use.encode(batch.column(1).to_pylist()):
            out["n_tokens"].append(len(ids) // 4)
            out["ids_crc32"].append(zlib.crc32(ids))
            out["decoded_sha256"].append(hashlib.sha256(decode(use.vocabulary, array("I", ids)).encode()).hexdigest())
        return out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string", rows=128, needs=("words",)).withColumnRenamed("doc_id", id_col)
