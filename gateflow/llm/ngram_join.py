"""Jaccard self-join on word shingles by T-occurrence search (DivideSkip) inside candidate blocks.

1. Documents become sets of hashed shingles; equal sets share one representative (smallest doc_id).
2. A set can only be similar to another one if the share J of its shingles occurs in other sets too. That is counted
   over all sets; most documents of a corpus end here.
3. Shingles of the rest are ordered by how many of its documents hold them, counted in a table of 2^20 hashed cells (a
   bounded size; cells only order shingles, so collisions cost time, never results). Two sets with similarity J share a shingle among the first n - ceil(J n) + 1 of either in that order. Sets
   that share such a shingle, directly or in a chain, form a cluster; no link crosses clusters.
4. A cluster is cut into blocks of bounded total size. In a block every set is searched in the inverted index of
   the block: short lists are merged by a heap, the longest ones are only probed by binary search (DivideSkip).
   Sets already known to be connected need no comparison, so a group of near copies costs one success each.
5. A cluster of several blocks first merges their leaders, level by level; then every pair of blocks that still
   holds more than one component is searched completely. So no link between components can be missed.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.common import arrow_map, grouped, materialise, mixed, range_hash, release, ship, shuffle_width, text_bytes
from gateflow.llm.components import connected_components

CELLS_LOG2 = 20      # hashed cells of the document frequencies
CHUNK_LOG2 = 12      # cells of one row while counts are merged
BATCH = 512          # documents whose shingles travel together while repeats are counted
SLICE = 32           # documents hashed at once
BLOCK_SHINGLES = 400_000  # shingles of a block: bounds the memory of a task
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIERS = [np.uint64(2 * x + 1) for x in (0x1D8E4E27C47D124F, 0x3C6EF372FE94F82B, 0x510E527FADE682D1,
                                                0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text.

    A-Z are lower-cased and words end at ASCII white space. A text with fewer words than ``width`` is one
    shingle of all its words; a null text or one without words gives an empty set.
    """
    if len(text) > SLICE:  # a few texts at a time: the hashes take many times the room of the bytes
        return [s for at in range(0, len(text), SLICE) for s in shingle_sets(text.slice(at, SLICE), width)]
    data, bounds = text_bytes(text)
    if not len(data):
        return [np.zeros(0, np.uint64)] * (len(bounds) - 1)
    low = _LOWER[data]
    word = ~_SPACE[low]
    # a word ends at white space or where its document ends
    first = np.zeros(len(low) + 1, bool)
    first[bounds[:-1]] = True
    starts = np.flatnonzero(word & (first[:-1] | np.r_[True, ~word[:-1]]))
    last = np.zeros(len(low) + 1, bool)
    last[bounds[1:]] = True
    ends = np.flatnonzero(word & (last[1:] | np.r_[~word[1:], True])) + 1
    hashes = range_hash(low).of(starts, ends)
    at = np.searchsorted(starts, bounds)
    n = len(hashes) - width + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        if n > 0:
            grams += hashes[k: k + n] * _MULTIPLIERS[k % len(_MULTIPLIERS)] + np.uint64(k)
    grams = mixed(grams)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a: b - width + 1]))
        elif b > a:
            short = hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(short, np.uint64).copy())
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Documents per hashed cell over all documents: 2^20 numbers, whatever the size of the input."""
    def count(batches):
        total = np.zeros(1 << CELLS_LOG2, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for s in shingle_sets(batch.column(0).slice(at, 512), width):
                    np.add.at(total, _cells(s), 1)
        parts = total.reshape(-1, 1 << CHUNK_LOG2)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(
            [zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())], names=["chunk", "counts"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(counts), np.int64)
                total[chunk] = total[chunk] + part if chunk in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
            [zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    ship(docs.sparkSession)
    parts = docs.select(text).mapInArrow(count, schema).repartition("chunk").mapInArrow(merge, schema)
    out = np.zeros((1 << (CELLS_LOG2 - CHUNK_LOG2), 1 << CHUNK_LOG2), np.int64)
    for row in parts.collect():  # at most 2^8 rows of 2^12 numbers
        out[row.chunk] = np.frombuffer(zlib.decompress(bytes(row.counts)), np.int64)
    return out.reshape(-1)


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, set_hash) of every row and, with n_shingles NULL, packed counts for ``_met``.

    Shingles travel to the bucket of their hash as sorted, compressed blocks of many documents, two to four bytes each,
    and only counts come back. A bucket is a fraction of a shuffle partition, and is what a task holds at once.
    """
    parts = shuffle_width(docs.sparkSession)
    buckets = 4 * parts
    kind = "bucket int, block binary, doc_id long, n_shingles long, set_key binary, set_hash long"

    def deal(batch):
        sets = shingle_sets(batch.column(1), width)
        n = len(sets)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        hashes = np.array([int.from_bytes(k[:8], "little", signed=True) if k else 0 for k in keys], np.int64)
        rows = np.arange(n)  # copies of a text may be very many: rows go round, whatever they hold
        yield {"bucket": (rows % buckets).astype(np.int32), "block": pa.nulls(n, pa.binary()), "doc_id": batch.column(0),
               "n_shingles": [len(s) for s in sets], "set_key": keys, "set_hash": hashes}
        first = list({k: i for i, k in enumerate(keys) if k}.values())  # equal sets of the batch once
        if not first:
            return
        grams = np.concatenate([sets[i] for i in first])
        owner = np.repeat(np.arange(len(first), dtype=np.uint16), [len(sets[i]) for i in first])
        to = (grams % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort(((grams >> np.uint64(32)), to))
        short, owner, to = (grams[order] >> np.uint64(32)).astype(np.uint32), owner[order], to[order]
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        names = hashes[first]
        out = {"bucket": [], "block": []}
        for b in np.flatnonzero(np.diff(cuts)):
            part = short[cuts[b]: cuts[b + 1]]
            steps = np.diff(part, prepend=np.uint32(0))
            own = owner[cuts[b]: cuts[b + 1]]
            used, own = np.unique(own, return_inverse=True)
            planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes() + own.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
            out["bucket"].append(int(b))
            out["block"].append(len(used).to_bytes(2, "little") + names[used].tobytes() + zlib.compress(planes, 1))
        n = len(out["bucket"])
        yield out | {"doc_id": pa.nulls(n, pa.int64()), "n_shingles": pa.nulls(n, pa.int64()),
                     "set_key": pa.nulls(n, pa.binary()), "set_hash": pa.nulls(n, pa.int64())}

    def opened(block: bytes):
        n = int.from_bytes(block[:2], "little")
        names = np.frombuffer(block, np.int64, n, 2)
        planes = np.frombuffer(zlib.decompress(block[2 + 8 * n:]), np.uint8).reshape(6, -1)
        steps = np.ascontiguousarray(planes[:4].T).view(np.uint32).ravel()
        own = np.ascontiguousarray(planes[4:].T).view(np.uint16).ravel()
        return np.cumsum(steps, dtype=np.uint32), names[own]

    def repeated(blocks: list[bytes]):
        """(set hashes, counts) of the shingles of one bucket that several sets hold."""
        pairs = [opened(b) for b in blocks]
        short, sets = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])
        order = np.lexsort((sets, short))
        short, sets = short[order], sets[order]
        new = np.r_[True, (short[1:] != short[:-1]) | (sets[1:] != sets[:-1])]  # a set once for each shingle
        short, sets = short[new], sets[new]
        same = short[1:] == short[:-1]
        return np.unique(sets[np.r_[same, False] | np.r_[False, same]], return_counts=True)

    def count(batches):
        met: dict[int, int] = {}

        def flush():
            """One row for each partition of sets, with all its counts."""
            sets, counts = np.array(list(met), np.int64), np.array(list(met.values()), np.int64)
            to = sets % parts
            targets = np.unique(to)
            rows = len(targets)
            yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()),
                                              pa.array(targets, pa.int64()), pa.array([np.stack(
                                                  [sets[to == t], counts[to == t]]).tobytes() for t in targets], pa.binary())], names=names)
            met.clear()

        def close():
            for h, c in zip(*(x.tolist() for x in repeated(held)), strict=True):
                met[h] = met.get(h, 0) + c

        names = ["doc_id", "n_shingles", "set_key", "set_hash", "met"]
        current, held = None, []
        for batch in batches:
            rows = batch.filter(batch.column(1).is_null())
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([*rows.columns[2:], pa.nulls(rows.num_rows, pa.binary())], names=names)
            blocks = batch.filter(batch.column(1).is_valid())
            for bucket, block in zip(blocks.column(0).to_pylist(), blocks.column(1).to_pylist(), strict=True):
                if bucket != current and held:
                    close()
                    held = []
                current = bucket
                held.append(block)
            if len(met) > 1 << 20:
                yield from flush()
        if held:
            close()
        yield from flush()
        held = []
        met.clear()
        release()

    dealt = arrow_map(docs.select("doc_id", "text"), deal, kind, rows=BATCH)
    return materialise(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        count, "doc_id long, n_shingles long, set_key binary, set_hash long, met binary"), "ngram-profiles")


def _met(packed: DataFrame) -> DataFrame:
    """(set_hash, met): how many shingles of a set other sets hold too. ``set_hash`` of the packed rows is a partition."""
    def add(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for block in batch.column(1).to_pylist():
                for h, c in zip(*np.frombuffer(block, np.int64).reshape(2, -1).tolist(), strict=True):
                    total[h] = total.get(h, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["set_hash", "met"])

    parts = shuffle_width(packed.sparkSession)
    return packed.select("set_hash", "met").repartition(parts, "set_hash").mapInArrow(add, "set_hash long, met long")


def required_overlap(a, b, similarity: Fraction):
    """Smallest intersection of sets of sizes a and b that reaches the similarity."""
    p, q = similarity.numerator, similarity.denominator
    return -(-p * (a + b) // (p + q))


class DivideSkip:
    """Inverted index of one block of sets; finds the sets that share at least T elements with a query."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, grams))
        self.owner = owner[order]
        self.keys, self.first = np.unique(grams[order], return_index=True)
        self.end = np.r_[self.first[1:], len(grams)]

    def search(self, query: np.ndarray, similarity: Fraction, skip=lambda r: False):
        """Indexes of the sets similar to ``query``, ascending; those for which ``skip`` is true are not checked."""
        n = len(query)
        if not n or not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        least = int(required_overlap(n, -(-similarity.numerator * n // similarity.denominator), similarity))
        if len(at) < least:
            return
        length = self.end[at] - self.first[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(length.max())
        # the published choice of the number of long lists
        probed = min(least - 1, int(least / (0.0085 * np.log2(longest + 1) + 1)))
        short = [self.owner[a:b].tolist() for a, b in zip(self.first[at[: len(at) - probed]],
                                                         self.end[at[: len(at) - probed]], strict=True)]
        long_ = at[len(at) - probed:]
        width = len(self.sizes)
        lists = np.concatenate([k * width + self.owner[self.first[a]: self.end[a]] for k, a in enumerate(long_)]
                               ) if probed else np.zeros(0, np.int64)
        shift = np.arange(len(long_)) * width
        need = least - probed  # in the short lists
        heap = [(s[0], i, 0) for i, s in enumerate(short)]
        heapq.heapify(heap)
        while len(heap) >= need:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
            if len(popped) >= need:
                if not skip(top):
                    found = len(popped)
                    enough = required_overlap(n, int(self.sizes[top]), similarity)
                    if found + len(long_) >= enough:
                        if len(lists):
                            p = np.searchsorted(lists, shift + top)
                            found += int((lists[np.minimum(p, len(lists) - 1)] == shift + top).sum())
                        if found >= enough:
                            yield top
                for _, i, p in popped:
                    if p + 1 < len(short[i]):
                        heapq.heappush(heap, (short[i][p + 1], i, p + 1))
            else:
                while heap and len(popped) < need - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    break
                goal = max(heap[0][0], top + 1)
                for _, i, p in popped:
                    p = bisect_left(short[i], goal, p)
                    if p < len(short[i]):
                        heapq.heappush(heap, (short[i][p], i, p))


class Forest:
    """Union-find inside one block; the smaller id is the root."""

    def __init__(self, labels):
        self.up: dict[int, int] = {x: x for x in labels}

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _block_links(width: int, similarity: Fraction):
    """Spanning links between the components of one block of (rep, label, side, text)."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_pylist()
        labels = table.column("label").to_pylist()
        sides = table.column("side").to_pylist()
        sets = shingle_sets(table.column("text").combine_chunks(), width)
        forest, links = Forest(labels), []
        both = len(set(sides)) > 1
        indexed = [i for i, s in enumerate(sides) if not both or s == 0]
        index = DivideSkip([sets[i] for i in indexed])
        apart = len(set(labels))
        for i in range(len(ids)):
            if apart == 1:  # all connected: nothing left to find
                break
            if both and sides[i] == 0:
                continue
            mine = labels[i]
            for r in index.search(sets[i], similarity, lambda r, m=mine: forest.root(labels[indexed[r]]) == forest.root(m)):
                other = indexed[r]
                if forest.root(labels[other]) != forest.root(mine):
                    links.append((ids[i], ids[other]))
                    forest.join(mine, labels[other])
                    apart -= 1
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})
    return run


def _search(blocks: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    return grouped(blocks, ["block"], _block_links(width, similarity), "u long, v long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                       similarity: Fraction = Fraction(85, 100)) -> DataFrame:
    """(id, n_shingles, component_id) of every row: documents linked, directly or in a chain, share a component.

    component_id is the smallest id of the component. Empty and null texts have 0 shingles and link nothing.
    Rows with equal ids count as one document. A null id links nothing and has a null component.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    p, q = similarity.numerator, similarity.denominator
    profile = _profiles(docs, width)
    every = profile.filter("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "set_key", "set_hash")
    named = every.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    reps = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("set_hash").alias("set_hash"))
    met = _met(profile.filter("n_shingles IS NULL"))
    hopeful = reps.join(met, "set_hash").filter(F.col("met") * q >= F.col("n") * p).select("rep", "n")
    texts = materialise(docs.join(hopeful, F.col("doc_id") == F.col("rep")).select("rep", "n", "text"), "ngram-texts")
    counts = spark.sparkContext.broadcast(document_frequencies(texts, "text", width))

    def heads(batch):
        rep, out = [], []
        for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
            k = len(s) - (-(-p * len(s) // q)) + 1 if len(s) else 0
            out.append(s[np.lexsort((s, counts.value[_cells(s)]))[:k]].view(np.int64))
            rep.append(np.full(k, i, np.int64))
        return {"doc_id": np.concatenate(rep), "gram": np.concatenate(out)}

    postings = materialise(arrow_map(texts.select("rep", "text"), heads, "doc_id long, gram long", rows=BATCH), "ngram-postings")
    # a list of two documents or more hangs its documents on the smallest one
    lists = postings.groupBy("gram").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("last")).filter("v < last")
    edges = (postings.join(lists.select("gram", "v"), "gram").select(F.col("doc_id").alias("u"), "v")
             .filter("u <> v").distinct())
    clusters = connected_components(edges, "ngram-clusters")
    links = _cluster_links(texts, clusters, width, similarity)
    same = named.join(reps.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).filter("u <> v")
    classes = connected_components(links.union(same), "ngram-classes")
    return (every.select("doc_id", "n_shingles")
            .join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def _cluster_links(texts: DataFrame, clusters: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """Spanning links of the similar sets of every cluster. Blocks carry texts, which are smaller than their sets."""
    # similar sets are in the same or in neighbouring bands of sizes
    band = F.floor(F.log("n") / float(np.log(similarity.denominator / similarity.numerator)) + 1e-9).cast("int")

    def blocks(rows: DataFrame) -> DataFrame:
        """Cut clusters whose sets are too large for one block by size band and salt; (rep, cluster, n) rows."""
        rows = rows.withColumn("band", band)
        by_band = rows.groupBy("cluster", "band").agg(F.sum("n").alias("band_weight"))
        weight = by_band.groupBy("cluster").agg(F.sum("band_weight").alias("weight"))
        return (rows.join(weight, "cluster").join(by_band, ["cluster", "band"])
                .withColumn("split", F.col("weight") > BLOCK_SHINGLES)
                .withColumn("band", F.when(F.col("split"), F.col("band")).otherwise(-1))
                .withColumn("parts", F.when(F.col("split"), F.ceil(F.col("band_weight") / BLOCK_SHINGLES)).otherwise(1))
                .select("rep", "cluster", "n", "band", "split",
                        F.concat_ws("/", "cluster", "band", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block")))

    members = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(texts.select("rep", "n"), "rep")
    cut = materialise(texts.select("rep", "text").join(blocks(members), "rep"), "ngram-blocks")
    links = materialise(_search(cut.select("block", "rep", F.col("rep").alias("label"), F.lit(0).alias("side"), "text"),
                                width, similarity), "ngram-links")
    split = cut.filter("split")
    if split.isEmpty():
        return links
    # leaders: one set for each component of a block, merged until a round finds no more
    while True:
        classes = connected_components(links, "ngram-levels")
        labelled = materialise(split.join(classes.withColumnRenamed("node", "rep"), "rep", "left")
                               .withColumn("label", F.coalesce("component", "rep")).drop("component"), "ngram-labelled")
        leaders = labelled.groupBy("block", "cluster", "label").agg(F.min("rep").alias("rep"), F.min_by("n", "rep").alias("n"))
        crowd = leaders.join(leaders.groupBy("cluster").agg(F.count_distinct("label").alias("labels"),
                                                            F.count_distinct("block").alias("held"))
                             .filter("labels > 1 AND held > 1").select("cluster"), "cluster")
        again = blocks(crowd.select("rep", "cluster", "n")).select("rep", F.col("block").alias("new"))
        more = materialise(_search(labelled.join(again, "rep").select(
            F.col("new").alias("block"), "rep", "label", F.lit(0).alias("side"), "text"), width, similarity), "ngram-links")
        if more.isEmpty():
            break
        links = materialise(links.union(more), "ngram-links")
    # what is left: pairs of blocks that hold more than one component
    held = (labelled.groupBy("cluster", "band", "block").agg(F.min("label").alias("low"), F.max("label").alias("high")))
    other = held.select("cluster", *[F.col(c).alias(f"{c}2") for c in ("band", "block", "low", "high")])
    pairs = (held.join(other, "cluster").filter("block < block2 AND abs(band - band2) <= 1")
             .filter("least(low, low2) < greatest(high, high2)")
             .select(F.concat_ws("|", "block", "block2").alias("pair"), "block", "block2"))
    dealt = pairs.select("pair", "block", F.lit(0).alias("side")).union(
        pairs.select("pair", F.col("block2"), F.lit(1)))
    rest = labelled.join(dealt, "block").select(F.col("pair").alias("block"), "rep", "label", "side", "text")
    return links.union(materialise(_search(rest, width, similarity), "ngram-links"))
