"""How the sources of a language differ in their words: exact smoothed shares, divergences of pairs, telling terms.

Terms are counted shard by shard with sorted pointers (``pointer_sort``); what leaves a task is one row for a term,
language and source. A share is an integer out of 1,000,000,000 and all arithmetic is whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc  # pa.compute is there only once something has imported it
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gateflow.llm.common import grouped, materialise, ship, text_bytes
from gateflow.llm.pointer_sort import Shard

SCALE = 1_000_000_000
SHARD = 8 << 20        # bytes of text whose pointers are sorted at once
HELD = 1 << 20         # rows a task holds before it hands them on
TILE = 128             # sources of one side of a block of pairs
BLOCK = 4096           # terms of a block, about
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])


def merged(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "count_sum", "docs_sum"]).rename_columns(COUNTS.names)


def shard_counts(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.Table:
    """Counts of the terms of some texts by language and source."""
    data, bounds = text_bytes(texts)
    pairs = pa.table({"l": langs.fill_null(""), "s": sources.fill_null("")})
    kinds = pairs.group_by(["l", "s"]).aggregate([])
    number = {key: i for i, key in enumerate(zip(*(c.to_pylist() for c in kinds.columns), strict=True))}
    group = np.array([number[key] for key in zip(*(c.to_pylist() for c in pairs.columns), strict=True)], np.int64)
    term, of, count, docs = Shard(data, bounds).counts(group)
    return pa.table([kinds.column(0).take(of), kinds.column(1).take(of), term.cast(pa.string()), pa.array(count), pa.array(docs)],
                    names=COUNTS.names).cast(COUNTS)


def shards(batch: pa.RecordBatch):
    """Stretches of a batch with about SHARD bytes of text each; a text is never cut."""
    _, bounds = text_bytes(batch.column(0))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SHARD, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _count_batches(batches):
    held: list[pa.Table] = []
    for batch in batches:
        for shard in shards(batch):
            held.append(shard_counts(*shard.columns))
            if sum(t.num_rows for t in held) > HELD:
                table = merged(held)
                held = [table]
                if table.num_rows > HELD // 2:
                    yield from table.combine_chunks().to_batches(max_chunksize=65_536)
                    held = []
    if held:
        yield from merged(held).combine_chunks().to_batches(max_chunksize=65_536)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term and documents (rows) that hold it; nulls are ''."""
    ship(docs.sparkSession)
    parts = docs.select(F.col(text_col), F.col(lang_col), F.col(source_col)).mapInArrow(
        _count_batches, "lang string, source string, term string, count long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) without rounding: products in 38 digits."""
    return F.lit(1) + F.call_function("div", (count + 2).cast("decimal(18,0)") * F.lit(SCALE).cast("decimal(10,0)"),
                                      (total + 2 * terms).cast("decimal(19,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def block_pairs(rows: pa.Table) -> pa.Table:
    """Divergences of the pairs of one block, summed over its terms.

    Rows with a term hold a source's share of it; rows without one name the sources of both tiles and their share of a
    term that they don't hold. Of a block of one tile with itself, every ordered pair comes out; of two tiles, both orders.
    """
    heads = rows.filter(pc.is_null(rows["term"]))
    sources = heads["source"].to_pylist()
    side = np.array(heads["tile"].to_pylist())
    none = np.array(heads["p"].to_pylist(), np.int64)
    given = rows.filter(pc.is_valid(rows["term"]))
    place = {s: i for i, s in enumerate(sources)}
    codes = pc.dictionary_encode(given["term"].combine_chunks()) if given.num_rows else None
    n = len(codes.dictionary) if codes is not None else 0
    shares = np.repeat(none[:, None], n, axis=1)
    if n:
        column = given["source"].combine_chunks().dictionary_encode()
        row = np.array([place[s] for s in column.dictionary.to_pylist()])[column.indices.to_numpy()]
        shares[row, codes.indices.to_numpy()] = given["p"].to_numpy()
    lang, a, b = (rows[c][0].as_py() for c in ("lang", "tile_a", "tile_b"))
    out = {"lang": [], "source": [], "item": [], "value": [], "terms": []}
    for i, source in enumerate(sources):
        others = np.flatnonzero(side == (side[i] if a == b else a + b - side[i]))
        others = others[others != i]
        gap = shares[others] - shares[i]
        sums = (gap * gap // (shares[others] + shares[i])).sum(axis=1)
        out["source"] += [source] * len(others)
        out["item"] += [sources[k] for k in others]
        out["value"] += sums.tolist()
    out["lang"] = [lang] * len(out["source"])
    out["terms"] = [n] * len(out["source"])
    return pa.table(out, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("terms", pa.int64())]))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      least_docs: int = 10, top: int = 10, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of every pair of sources, and the terms that tell a source.

    A term is a run of letters A-Z and characters beyond ASCII, A-Z lower-cased; a language keeps the terms of at least
    ``least_docs`` of its documents. Every row is a document. Null texts, languages and sources are ''. Sources without
    terms take part with their smoothed shares. Ties are ranked by the bytes of the item. Other columns are left alone;
    an empty table gives an empty result.

    Pairs are summed in blocks of two tiles of sources and some terms, so neither a language with very many sources nor
    one with very many terms meets in one task.
    """
    counts = materialise(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = materialise(counts.groupBy("lang", "term").agg(F.sum("count").alias("in_lang"), F.sum("docs").alias("docs"))
                       .filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("n_lang"))
    known = counts.join(kept, ["lang", "term"])
    totals = known.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    seen = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    # a row for each (lang, source): its tile by rank among the sources of the language
    groups = (seen.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"),
                      F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / tile).cast("int").alias("tile"),
                      F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1) / tile).cast("int").alias("last_tile")))
    groups = materialise(groups, "source-groups")
    facts = groups.filter("v > 0").withColumn("none", share(F.lit(0), F.col("n"), F.col("v")))
    shares = materialise(known.join(facts, ["lang", "source"]).select(
        "lang", "source", "term", "tile", "last_tile", "v", share(F.col("count"), F.col("n"), F.col("v")).alias("p"),
        share(F.col("in_lang"), F.col("n_lang"), F.col("v")).alias("q")), "term-shares")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = (shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top))

    n_blocks = F.ceil(F.col("v") / block).cast("int")
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("last_tile")), lambda t: F.struct(
        F.least(t, F.col("tile")).alias("tile_a"), F.greatest(t, F.col("tile")).alias("tile_b"))))
    cells = shares.select("lang", "source", "tile", "term", "p", F.pmod(F.xxhash64("term"), n_blocks).cast("int").alias("block"), tiles.alias("pair"))
    heads = facts.select("lang", "source", "tile", F.lit(None).cast("string").alias("term"), F.col("none").alias("p"),
                         "last_tile", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block")).select(
        "lang", "source", "tile", "term", "p", "block", tiles.alias("pair"))
    blocks = cells.unionByName(heads).select("lang", "source", "tile", "term", "p", "block", "pair.tile_a", "pair.tile_b")
    sums = grouped(blocks, ["lang", "tile_a", "tile_b", "block"], block_pairs, "lang string, source string, item string, value long, terms long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    # terms that neither source's tile holds differ by the shares of absent terms alone
    one = facts.select("lang", "source", "v", F.col("none").alias("p"))
    other = facts.select("lang", F.col("source").alias("item"), F.col("none").alias("q"))
    measured = (sums.join(one, ["lang", "source"]).join(other, ["lang", "item"])
                .select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("terms")) * divergence(F.col("p"), F.col("q"))).alias("value")))
    # languages that keep no term: every pair has divergence 0
    bare = groups.filter("v = 0").select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = (measured.unionByName(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
             .withColumn("rank", F.row_number().over(by_value)))
    return pairs.unionByName(told)
