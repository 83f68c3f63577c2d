"""Removal of long repeated byte strings with suffix arrays built block by block.

1. Every string of ``length`` bytes names an anchor: the smallest hash among its windows of length / 2 bytes. The
   choice depends on the bytes alone, so equal strings name equal anchors. Starts that share an anchor form a region.
2. Anchors that occur once cannot hold a repeat. Of the others, equal regions share one copy and repeat each other
   whole; only distinct regions around an equal anchor need sorting.
3. Distinct regions are dealt to blocks of bounded size, all regions of an anchor to one block; an anchor with very
   many of them is spread over several. Each block gets a suffix array by two-stage sorting, and neighbours in it
   with a common prefix of ``length`` bytes are repeats. For anchors spread over blocks, digests of the strings
   decide across blocks.
4. Covered ranges go back to all copies of a region and from there to the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.common import arrow_map, grouped, materialise, range_hash, text_bytes

SEGMENT = 1 << 22        # bytes hashed at once; the position of an anchor takes 22 bits
BLOCK_BYTES = 256 << 10  # bytes of the regions of a block
SPREAD = 4096            # distinct regions of one anchor before it is spread over blocks


def regions(data: np.ndarray, length: int):
    """(anchor, region hash, first start, last start) arrays of all regions of one text."""
    window = length // 2
    span = length - window + 1  # windows in a string
    out = []
    for base in range(0, max(0, len(data) - length + 1), SEGMENT - length + 1):
        part = data[base: base + SEGMENT]
        hashed = range_hash(part).sliding(window)
        packed = (hashed & ~np.uint64(SEGMENT - 1)) | np.arange(len(hashed), dtype=np.uint64)
        n = len(packed) - span + 1
        padded = np.full(-(-len(packed) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(packed)] = packed
        rows = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[span - 1: span - 1 + n])
        lo = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
        hi = np.r_[lo[1:] - 1, n - 1]
        anchor = hashed[(least[lo] & np.uint64(SEGMENT - 1)).astype(np.int64)]
        whole = range_hash(part, 1).of(lo, hi + length)
        out.append((anchor, whole, lo + base, hi + base))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None


def suffix_order(data: bytes, runs: list[tuple[int, int]], length: int) -> list[int]:
    """Starts of ``runs`` (first, last start) in the order of the ``length`` bytes that follow, two-stage sorted.

    A start is sorted directly if its suffix is smaller than the next one, or if it ends its run. The others are
    induced: when a suffix is reached in the scan, the one that starts a byte earlier and is larger goes to the next
    free place of the bucket of its first byte.
    """
    raw = np.frombuffer(data, np.uint8)
    descends = np.zeros(len(raw) + 1, bool)  # suffix larger than its successor
    inside = np.zeros(len(raw) + 1, bool)
    for first, last in runs:
        end = min(len(raw), last + length)
        part = raw[first:end].astype(np.int16)
        step = np.r_[np.sign(np.diff(part)), -1]  # the end of a region is smaller than any byte
        known = np.where(step != 0, np.arange(len(step)), len(step))
        nearest = np.minimum.accumulate(known[::-1])[::-1]
        descends[first:end] = step[nearest] < 0
        inside[first:last] = True  # the last start of a run has no successor among the starts
    induced = (descends & inside).tolist()
    starts = np.concatenate([np.arange(a, b + 1) for a, b in runs]) if runs else np.zeros(0, np.int64)
    direct = starts[~(descends & inside)[starts]].tolist()
    direct.sort(key=lambda i: data[i: i + length])
    larger = descends.tolist()
    buckets: list[list[int]] = [[] for _ in range(256)]
    for i in direct:
        buckets[data[i]].append(i)
    queues: list[list[int]] = [[] for _ in range(256)]
    order: list[int] = []
    put = order.append
    for c in range(256):
        waiting, own = queues[c], buckets[c]
        at = 0
        for x in own:
            if larger[x]:  # a run's last start that is not smaller than what follows it: compare with the induced ones
                key = data[x: x + length]
                while at < len(waiting) and data[waiting[at]: waiting[at] + length] < key:
                    i = waiting[at]
                    at += 1
                    put(i)
                    if i and induced[i - 1]:
                        queues[data[i - 1]].append(i - 1)
            else:
                while at < len(waiting):
                    i = waiting[at]
                    at += 1
                    put(i)
                    if i and induced[i - 1]:
                        queues[data[i - 1]].append(i - 1)
            put(x)
            if x and induced[x - 1]:
                queues[data[x - 1]].append(x - 1)
        while at < len(waiting):
            i = waiting[at]
            at += 1
            put(i)
            if i and induced[i - 1]:
                queues[data[i - 1]].append(i - 1)
    return order


def _merged(starts: np.ndarray, length: int) -> list[int]:
    """Flat [from, to, from, to, ...] of the bytes covered by strings at sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + length], 1).ravel().tolist()


def _sort_block(length: int):
    def run(rows: pa.Table) -> pa.Table:
        blobs = rows.column("bytes").to_pylist()
        spread = rows.column("spread").to_pylist()
        data = b"".join(blobs)
        base = np.r_[0, np.cumsum([len(b) for b in blobs])]
        runs = [(int(a), int(b) - length) for a, b in zip(base[:-1], base[1:], strict=True)]
        order = suffix_order(data, runs, length)
        covered = np.zeros(len(data), bool)
        single: dict[int, list[int]] = {i: [] for i, s in enumerate(spread) if s}
        digests: dict[int, list[int]] = {i: [] for i in single}
        owner = np.repeat(np.arange(len(blobs)), np.diff(base)) if single else None
        before = None
        for k, i in enumerate(order):
            text = data[i: i + length]
            if text == before:  # common prefix of the whole length
                covered[i] = covered[order[k - 1]] = True
            elif single and spread[owner[i]]:
                digests[owner[i]].append(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True))
                single[owner[i]].append(i - int(base[owner[i]]))
            before = text
        out = [_merged(np.flatnonzero(covered[a: b + 1]), length) for a, b in runs]
        return pa.table({"anchor": rows.column("anchor"), "region": rows.column("region"),
                         "ranges": pa.array(out, pa.list_(pa.int32())),
                         "starts": pa.array([single.get(i) for i in range(len(blobs))], pa.list_(pa.int32())),
                         "digests": pa.array([digests.get(i) for i in range(len(blobs))], pa.list_(pa.int64()))})
    return run


def repeated_ranges(docs: DataFrame, length: int = 400, spread: int = SPREAD) -> DataFrame:
    """(doc_id, text_key, ranges) of the documents with repeated strings: a list of flat lists of byte ranges."""
    if length < 4:
        raise ValueError("length must be 4 bytes or more")
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def anchors(batch):
        data, bounds = text_bytes(batch.column(2))
        found = [(i, regions(data[a:b], length)) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
                 if b - a >= length]
        if not found:
            return None
        rows = pa.array(np.concatenate([np.full(len(r[0]), i) for i, r in found]))
        cols = [np.concatenate([r[k] for _, r in found]) for k in range(4)]
        return {"doc_id": batch.column(0).take(rows), "text_key": batch.column(1).take(rows),
                "anchor": cols[0].view(np.int64), "region": cols[1].view(np.int64),
                "lo": cols[2].astype(np.int32), "hi": cols[3].astype(np.int32)}

    every = materialise(arrow_map(docs, anchors, "doc_id long, text_key long, anchor long, region long, lo int, hi int",
                                  rows=256), "suffix-anchors")
    # stored first, so that the join below reads two plain shuffles, of which Spark can split a frequent anchor
    twice = materialise(every.groupBy("anchor").agg(F.count("*").alias("held")).filter("held > 1").select("anchor"), "suffix-twice")
    some = materialise(every.join(twice, "anchor"), "suffix-repeated")
    distinct = materialise(some.groupBy("anchor", "region").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "lo", "hi")).alias("at")), "suffix-regions")
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    sort = distinct.join(kinds, "anchor")
    total = sort.agg(F.sum(F.col("at.hi") - F.col("at.lo") + length)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    placed = (sort.withColumn("spread", F.col("kinds") > spread)
              .withColumn("block", F.when(F.col("spread"), F.concat_ws("/", "anchor", F.expr(
                  f"pmod(region, ceil(kinds / {spread}))"))).otherwise(F.expr(f"cast(pmod(anchor, {blocks}) AS string)"))))
    wanted = placed.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key")).agg(
        F.collect_list(F.struct("block", "spread", "anchor", "region", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi")))
        .alias("cut"))
    joined = docs.alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id AND d.text_key = w.text_key")).select("text", "cut")

    def fetch(batch):
        data, bounds = text_bytes(batch.column(0))
        out = {c: [] for c in ("block", "spread", "anchor", "region", "bytes")}
        for start, cuts in zip(bounds[:-1].tolist(), batch.column(1).to_pylist(), strict=True):
            for c in cuts:
                for name in ("block", "spread", "anchor", "region"):
                    out[name].append(c[name])
                out["bytes"].append(data[start + c["lo"]: start + c["hi"] + length].tobytes())
        return out

    # copies of a row would bring a region twice
    cuts = materialise(arrow_map(joined, fetch, "block string, spread boolean, anchor long, region long, bytes binary", rows=64)
                       .dropDuplicates(["anchor", "region"]), "suffix-cuts")
    sorted_ = materialise(grouped(cuts, ["block"], _sort_block(length),
                                  "anchor long, region long, ranges array<int>, starts array<int>, digests array<long>"),
                          "suffix-sorted")
    strings = sorted_.filter("starts IS NOT NULL").select(
        "anchor", "region", F.explode(F.arrays_zip("starts", "digests")).alias("s")).select(
        "anchor", "region", F.col("s.starts").alias("start"), F.col("s.digests").alias("digest"))
    met = strings.groupBy("anchor", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "digest")
    across = strings.join(met, ["anchor", "digest"]).select("anchor", "region", F.array("start", F.col("start") + length).alias("ranges"))
    ranges = (sorted_.filter(F.size("ranges") > 0).select("anchor", "region", "ranges").union(across)
              .union(distinct.filter("copies > 1").select("anchor", "region", F.array(
                  F.lit(0), F.col("at.hi") - F.col("at.lo") + length).alias("ranges"))))
    per_region = ranges.groupBy("anchor", "region").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    shifted = some.join(per_region, ["anchor", "region"]).select(
        "doc_id", "text_key", F.transform("ranges", lambda x: x + F.col("lo")).alias("ranges"))
    return shifted.groupBy("doc_id", "text_key").agg(F.collect_list("ranges").alias("ranges"))


def _union(ranges, n: int) -> list[tuple[int, int]]:
    flat = sorted((a, b) for r in ranges or () for a, b in zip(r[::2], r[1::2], strict=True))
    out: list[list[int]] = []
    for a, b in flat:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   spread: int = SPREAD, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, *keep): texts without the bytes of strings that occur twice or more.

    Texts are UTF-8 bytes, a null one is empty; ``kept`` holds the remaining bytes, or with ``as_text`` what ``kept_text``
    makes of them, in the same call: a second Python function in a task would take a second worker. Equal rows repeat each other.
    A string of ``length`` bytes counts if it starts anywhere else, also in the same text and overlapping.
    Documents with null or equal ids are told apart by their text. ``keep`` names columns to carry along.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    # a text that several equal rows hold repeats as a whole; one of the rows stands for it in what follows
    equal = materialise(plain.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).filter("rows > 1")
                        .select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), F.lit(True).alias("equal")), "suffix-equal")
    same = F.expr("d.doc_id <=> e.of AND d.text_key = e.of_key")
    if not equal.isEmpty():
        marked = plain.alias("d").join(equal.alias("e"), same, "left")
        once = marked.filter("equal").groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
        ranges = repeated_ranges(marked.filter("equal IS NULL").select("doc_id", "text").unionByName(once.select("doc_id", "text")), length, spread)
    else:
        ranges = repeated_ranges(plain, length, spread)
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"),
                       carried.alias("carried"))
    marked = rows.alias("d").join(equal.alias("e"), same, "left").select("d.*", "equal")
    joined = (marked.alias("d").join(ranges.alias("r"), F.expr("equal IS NULL AND d.doc_id <=> r.doc_id AND d.text_key = r.text_key"), "left")
              .select("d.doc_id", "text", "ranges", "carried", "equal"))

    def cut(batch):
        data, bounds = text_bytes(batch.column(1))
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept")}
        for a, b, r, whole in zip(bounds[:-1].tolist(), bounds[1:].tolist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            spans = [(0, b - a)] if whole and b - a >= length else _union(r, b - a)
            edges = [0, *[x for s in spans for x in s], b - a]
            out["kept"].append(b"".join(data[a + x: a + y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
            out["n_bytes"].append(b - a)
            out["n_removed"].append(b - a - len(out["kept"][-1]))
            out["n_spans"].append(len(spans))
        if as_text:
            out["kept"] = [kept_text(b) for b in out["kept"]]
        return {"doc_id": batch.column(0), **out, "carried": batch.column(3)}

    kind = joined.schema["carried"].dataType.simpleString()
    done = arrow_map(joined, cut, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, carried {kind}", rows=256)
    return done.select(F.col("doc_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept",
                       *[F.col(f"carried.{c}").alias(c) for c in keep])


def kept_text(kept: bytes) -> str:
    """Remaining bytes as text; halves of characters at the edges of a removed range go with it."""
    return kept.decode("utf-8", "ignore")
