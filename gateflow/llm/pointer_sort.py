"""Sorting terms by pointers: word starts over one byte buffer, multikey quicksort over eight-byte slices.

A shard is a stretch of texts in one Arrow buffer. Its words are never cut out: a pointer is the offset at which a word
starts, and pointers are sorted by the bytes behind them. The sort goes breadth first: all pointers are put in order of
their first slice, then each run of equal slices whose words go on is put in order of the next one, until every run
holds one word. Equal runs give the counts of a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Bytes of a term: A-Z, a-z and everything beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32
SLICE = 8


class Shard:
    """Texts in one buffer, lower-cased (A-Z), with the pointers of their terms: ``start``, ``end`` and ``doc`` (row)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = np.concatenate([LOWERED[data], np.zeros(SLICE, np.uint8)])  # room behind the last word
        inside = TERM[data]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        opens = edge[:-1] == 1
        closes = edge[1:] == -1
        inner = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
        inner = inner[inside[inner] & inside[inner - 1]]  # a word does not reach from one text into the next
        opens[inner], closes[inner - 1] = True, True
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.doc = np.searchsorted(bounds, self.start, "right") - 1
        self.view = np.ndarray((len(self.data) - SLICE + 1,), ">u8", buffer=self.data, strides=(1,))

    def slices(self, which: np.ndarray, depth: int) -> np.ndarray:
        """Slice number ``depth`` of the words behind the pointers as numbers in byte order; zeros follow a word's end."""
        at = self.start[which] + SLICE * depth
        left = np.clip(self.end[which] - at, 0, SLICE)
        words = self.view[np.minimum(at, len(self.data) - SLICE)].astype(np.uint64)
        shift = ((SLICE - left) * 8).astype(np.uint64)
        words = np.where(left > 0, (words >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)), np.uint64(0))
        return words

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, run): pointers in byte order of their words, and the number of each one's word."""
        n = len(self.start)
        key = self.slices(np.arange(n), 0)
        order = np.argsort(key)
        key = key[order]
        begins = np.ones(n, bool)
        begins[1:] = key[1:] != key[:-1]
        depth = 1
        length = self.end - self.start
        open_ = np.arange(n)  # places whose words may still differ from their neighbours in the run
        while True:
            run = np.cumsum(begins[open_]) if len(open_) < n else np.cumsum(begins)
            # a run stays open if it holds two pointers or more and a word in it goes on
            last = np.flatnonzero(np.append(run[1:] != run[:-1], True)) if len(run) else np.zeros(0, np.int64)
            first = np.append(0, last[:-1] + 1) if len(last) else last
            if not len(last):
                break
            goes_on = np.maximum.reduceat(length[order[open_]], first) > SLICE * depth
            keep = np.repeat(goes_on & (last > first), last - first + 1)
            open_, run = open_[keep], run[keep]
            if not len(open_):
                break
            pointers = order[open_]
            key = self.slices(pointers, depth)
            place = np.lexsort((key, run))
            order[open_], key = pointers[place], key[place]
            differs = (key[1:] != key[:-1]) & (run[1:] == run[:-1])  # runs hold the same places as before
            begins[open_[1:][differs]] = True
            depth += 1
        return order, np.cumsum(begins) - 1

    def words(self, pointers: np.ndarray) -> pa.Array:
        """The words behind the pointers as strings."""
        start, size = self.start[pointers], (self.end - self.start)[pointers]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(pointers), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[at].tobytes()))

    def counts(self, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(term, group, count, documents) of every term and group of texts that occur together; ``group`` is one number a text."""
        if not len(self.start):
            return pa.array([], pa.large_string()), *(np.zeros(0, np.int64),) * 3
        order, run = self.sort()
        heads = order[np.append(True, run[1:] != run[:-1])]
        by_group = np.argsort(group, kind="stable")
        number = np.empty(len(group), np.int64)
        number[by_group] = np.arange(len(group))  # texts numbered group by group
        place = np.sort(run * len(group) + number[self.doc[order]])
        fresh_doc = np.append(True, place[1:] != place[:-1])
        term, of = place // len(group), group[by_group][place % len(group)]
        at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (of[1:] != of[:-1])))
        count = np.diff(np.append(at, len(place)))
        return self.words(heads[term[at]]), of[at], count, np.add.reduceat(fresh_doc.astype(np.int64), at)
