"""Packing of token sequences by linear grouping, configurations and best fit.

Lengths are whole numbers up to the capacity, so how many pieces have each length says everything the plan needs: at
most ``capacity`` numbers reach the driver, whatever the size of the corpus. There the large lengths are put into groups
of equal cardinality and rounded up to the longest of their group, a linear program over configurations (column
generation) decides how the few rounded lengths share sequences, actual lengths replace the rounded ones, and the
remaining and small pieces go where they fit best. The plan maps ranges of ranks within a length to sequences, and Spark
looks up every piece by its length and its rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gateflow.llm.common import arrow_map, materialise, salted, shuffle_width
from gateflow.llm.tokens import word_encoder

GROUPS = 48         # groups of equal cardinality
SHARES = (2, 3, 4, 8)  # large: longer than the capacity divided by one of these
RANK_BITS = 48


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
                 end: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every text's ids with ``end`` behind them, cut into pieces of ``capacity``.

    A null text is empty. Only texts longer than the capacity have more than one piece.
    """
    def cut(batch):
        encoder, tail = word_encoder(tokenizer), int(end).to_bytes(4, "little")
        out = {c: [] for c in ("row", "piece", "start", "length", "ids_crc32")}
        for row, ids in enumerate(encoder.encode(batch.column(1))):
            ids += tail
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at: at + 4 * capacity]
                for c, v in zip(out, (row, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[c].append(v)
        return {"doc_id": batch.column(0).take(pa.array(out.pop("row"), pa.int64()))} | out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", rows=256, needs=("words",))


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """Columns (pieces of each size in a sequence) and how often to use them: the linear program of least sequences.

    Column generation: a basis of columns covers the demand exactly; the most valuable new column at the current dual
    prices is found by a knapsack and enters until none is worth more than a sequence.
    """
    n = len(sizes)
    d = np.asarray(demand, float)
    scale = d.max() if n else 1.0
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(40 * n + 100):
        x = np.linalg.solve(basis, d / scale)
        prices = np.linalg.solve(basis.T, np.ones(n))
        # value[k][c]: most that k pieces of total length up to c are worth
        value, taken = [np.zeros(capacity + 1)], []
        for _ in range(capacity // min(sizes)):
            best, by = value[-1].copy(), np.full(capacity + 1, -1)
            for g, s in enumerate(sizes):
                worth = value[-1][: capacity + 1 - s] + prices[g]
                better = worth > best[s:] + 1e-12
                best[s:][better] = worth[better]
                by[s:][better] = g
            value.append(best)
            taken.append(by)
        if value[-1][capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(n), capacity
        for by in reversed(taken):
            if by[c] >= 0:
                column[by[c]] += 1
                c -= sizes[by[c]]
        direction = np.linalg.solve(basis, column)
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.where(able, np.maximum(x, 0) / np.where(able, direction, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, d / scale) * scale if n else []
    return [(tuple(int(round(v)) for v in basis[:, j]), max(0.0, float(x[j]))) for j in range(n)]


class _Run:
    """``count`` sequences filled alike: each item is (size, first rank), sequence k holding rank first + k * step."""
    __slots__ = ("first", "count", "room", "items")

    def __init__(self, first, count, room, items):
        self.first, self.count, self.room, self.items = first, count, room, items

    def split(self, k: int) -> _Run:
        rest = _Run(self.first + k, self.count - k, self.room, [(s, r + k) for s, r in self.items])
        self.count = k
        return rest


class _Supply:
    """Segments (size, first rank, count) taken from the front."""

    def __init__(self, segments):
        self.segments, self.at = segments, 0

    def take(self, k: int) -> list[tuple[int, int, int]]:
        out = []
        while k:
            size, rank, count = self.segments[self.at]
            m = min(k, count)
            out.append((size, rank, m))
            k -= m
            if m == count:
                self.at += 1
            else:
                self.segments[self.at] = (size, rank + m, count - m)
        return out

    def rest(self):
        return self.segments[self.at:]


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> dict[str, np.ndarray]:
    """Arrays size, rank, sequence, offset sorted by (size, rank): where each range of ranks of a size goes.

    What counts as large is a free choice of the scheme; of the usual shares of the capacity the one that needs
    the fewest sequences is taken.
    """
    return min((_plan(counts, capacity, groups, capacity // share) for share in SHARES), key=lambda x: x[0])[1]


def _plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> tuple[int, dict[str, np.ndarray]]:
    """Number of sequences and the plan, with lengths over ``small`` as the large ones."""
    runs: list[_Run] = []
    used = 0

    def open_runs(count: int, parts: list[list[tuple[int, int, int]]]) -> None:
        """``count`` new sequences; each part gives one piece to every sequence."""
        nonlocal used
        cuts = sorted({0, count} | {int(c) for part in parts for c in np.cumsum([m for *_, m in part])})
        place = [(iter(part), [None, 0]) for part in parts]
        held = []
        for segments, _ in place:
            held.append([*next(segments), 0])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            items, room = [], capacity
            for i, (segments, _) in enumerate(place):
                size, rank, m, seen = held[i]
                if seen == m:
                    held[i] = [*next(segments), 0]
                    size, rank, m, seen = held[i]
                items.append((size, rank + seen))
                held[i][3] = seen + b - a
                room -= size
            runs.append(_Run(used + a, b - a, room, items))
        used += count

    order = sorted((s for s, c in counts.items() if c > 0), reverse=True)
    if counts.get(capacity, 0):
        open_runs(counts[capacity], [[(capacity, 0, counts[capacity])]])
    large = [(s, counts[s]) for s in order if small < s < capacity]
    total = sum(c for _, c in large)
    left: list[tuple[int, int, int]] = []
    if total:
        target = -(-total // groups)
        members: list[list[tuple[int, int, int]]] = [[]]
        filled = 0
        for s, c in large:
            rank = 0
            while c:
                m = min(c, target - filled)
                members[-1].append((s, rank, m))
                rank, c, filled = rank + m, c - m, filled + m
                if filled == target:
                    members.append([])
                    filled = 0
        members = [m for m in members if m]
        rounded: dict[int, list] = {}
        for m in members:  # groups that round to the same length are one
            rounded.setdefault(m[0][0], []).extend(m)
        sizes = list(rounded)
        supply = [_Supply(list(rounded[s])) for s in sizes]
        have = [sum(c for *_, c in rounded[s]) for s in sizes]
        for column, times in configurations(sizes, have, capacity):
            whole = int(times + 1e-6)
            whole = min([whole, *[have[g] // k for g, k in enumerate(column) if k]])
            if whole > 0 and any(column):
                open_runs(whole, [supply[g].take(whole) for g, k in enumerate(column) for _ in range(k)])
                have = [h - k * whole for h, k in zip(have, column, strict=True)]
        left = [x for s in supply for x in s.rest()]
    # best fit, longest first, on runs of equal room
    by_room: dict[int, list[_Run]] = {}
    rooms: list[int] = []

    def offer(run: _Run) -> None:
        if run.room not in by_room:
            by_room[run.room] = []
            insort(rooms, run.room)
        by_room[run.room].append(run)

    for run in runs:
        offer(run)
    done = runs
    for size, rank, count in sorted(left, reverse=True) + [(s, 0, counts[s]) for s in order if s <= small]:
        while count:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                run = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                per = max(1, min(capacity // size, count))
                run = _Run(used, max(1, count // per), capacity, [])
                used += run.count
                done.append(run)
                room = capacity
            per = min(room // size, count)
            k = min(run.count, max(1, count // per))
            if k < run.count:
                rest = run.split(k)
                done.append(rest)
                offer(rest)
            for t in range(per):
                run.items.append((size, rank + t * k))
            run.room -= per * size
            rank += per * k
            count -= per * k
            offer(run)
    entries = []
    for run in done:
        offset = 0
        for size, rank in run.items:
            entries.append((size, rank, run.first, offset))
            offset += size
    entries.sort()
    cols = np.array(entries, np.int64).reshape(-1, 4).T
    return used, dict(zip(("size", "rank", "sequence", "offset"), cols, strict=True))


def pack(pieces: DataFrame, length_col: str = "length", order_by: tuple[str, ...] = ("doc_id", "piece"),
         capacity: int = 2048, groups: int = GROUPS) -> DataFrame:
    """``pieces`` with sequence_id and offset; lengths are from 1 to ``capacity``, sequences have no gaps.

    Equal rows are separate pieces. Ties in ``order_by`` decide only which of equal pieces takes which place.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    parts = 4 * shuffle_width(spark)
    dealt = materialise(pieces.withColumn("salt", salted(parts, *order_by)), "packing-pieces")
    held = dealt.groupBy(length_col, "salt").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in held.groupBy(length_col).agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    made = plan(counts, capacity, groups)
    sent = spark.sparkContext.broadcast(made | {"key": (made["size"] << RANK_BITS) | made["rank"]})
    # rank of a piece among those of its length: rank in its salt, behind the pieces of lower salts
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy(length_col).orderBy("salt")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy(length_col, "salt").orderBy(*order_by)) - 1
    ranked = dealt.withColumn("inside", inside).join(before, [length_col, "salt"]).withColumn("rank", F.col("before") + F.col("inside"))
    names = [c for c in dealt.columns if c != "salt"]
    ranked = ranked.select(*names, "rank")

    def look_up(batch):
        p = sent.value
        size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, "rank"))
        at = np.searchsorted(p["key"], (size << RANK_BITS) | rank, "right") - 1
        return {c: batch.column(i) for i, c in enumerate(names)} | {
            "sequence_id": p["sequence"][at] + rank - p["rank"][at], "offset": p["offset"][at]}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return arrow_map(ranked, look_up, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
                   end: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all texts."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity, end)
    return pack(pieces, capacity=capacity).withColumnRenamed("doc_id", id_col)
