"""Document fingerprints by invertible Bloom lookup sketches, with DataFrame functions only.

A text is a set of paragraph digests. A sketch has three tables of cells; every digest is added to one cell of each: the
cell counts, and keeps the exclusive or of digests and of check values. Cells of two versions subtract, which leaves the
digests that differ. Peeling takes a cell that holds a single digest, removes that digest from its other cells and goes
on, table by table. If cells remain, the pair is tried again with a sketch of twice the size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gateflow.llm.common import materialise, shared_folder, shuffle_width

# A paragraph ends with its line, or at the end of a word after 112 characters.
PARAGRAPH = r"\S[^\n]{0,111}\S*"
# A sentence ends with its line or full stop, or at the end of a word after 96 characters: the cuts of two versions meet
# again at the next full stop, where those of paragraphs differ up to the next line end.
SENTENCE = r"\S[^\n.!?]{0,95}[^\s.!?]*[.!?]*"
TABLES = 3
BASE_WIDTH = 8   # cells of each table of a published fingerprint
CELLS = 1.6      # cells of a comparison for each digest of the pair
ROUNDS = 11      # peeling passes over one table each
ATTEMPTS = 8     # doublings before the exact digests are compared instead


def paragraph_digests(text: Column, unit: str = PARAGRAPH) -> Column:
    """Distinct 64-bit digests of the paragraphs (matches of ``unit``) of a text; an empty or null text has none."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(unit), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _slot(key: Column, table: int, width: Column, attempt: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(10 * attempt + table)), width) + width * table


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1))


def _cells(digests: DataFrame, keys: list[str], attempt: int) -> DataFrame:
    """Sketch cells of (keys, width, digest, sign) rows: (keys, width, slot, n, key, check)."""
    key, width = F.col("digest"), F.col("width")
    return (digests.select(*keys, "width", "digest", "sign", F.explode(F.array(*[_slot(key, t, width, attempt) for t in range(TABLES)])).alias("slot"))
            .groupBy(*keys, "width", "slot").agg(F.sum("sign").alias("n"), F.bit_xor("digest").alias("key"),
                                                 F.bit_xor(_check(key)).alias("check")))


def _peel(cells: DataFrame, keys: list[str], attempt: int, keep: bool) -> DataFrame:
    """(keys, side, slot, n): recovered digests have side 1 or -1; what is left has side 0.

    With ``keep`` a recovered digest stands in ``slot``, otherwise ``n`` counts those of a side. A digest has one cell
    in each table, so within a pass over one table no digest is removed twice.
    """
    state = cells.select(*keys, "width", F.lit(0).cast("long").alias("side"), "slot", "n", "key", "check")
    fields = ("side", "slot", "n", "key", "check")
    for turn in range(ROUNDS):
        table = turn % TABLES
        key, width, n = F.col("key"), F.col("width"), F.col("n")
        single = ((F.col("side") == 0) & (F.abs(n) == 1) & (F.floor(F.col("slot") / width) == table)
                  & (F.col("check") == _check(key)) & (F.col("slot") == _slot(key, table, width, attempt)))
        zero = F.lit(0).cast("long")
        found = F.struct(n.alias("side"), (key if keep else zero).alias("slot"), F.lit(1).cast("long").alias("n"), zero.alias("key"), zero.alias("check"))
        others = [F.struct(zero.alias("side"), _slot(key, t, width, attempt).alias("slot"), (-n).alias("n"), key.alias("key"),
                           F.col("check").alias("check")) for t in range(TABLES) if t != table]
        state = (state.select(*keys, "width", F.inline(F.when(single, F.array(found, *others)).otherwise(
            F.array(F.struct(*fields)))).alias(*fields))
            .groupBy(*keys, "width", "side", "slot").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
            .filter("side <> 0 OR n <> 0 OR key <> 0 OR check <> 0"))
    return state.select(*keys, "side", "slot", "n")


def differences(pairs: DataFrame, keys: list[str], keep: bool = True) -> DataFrame:
    """(keys, digest, side, n) of the paragraphs in which the two digest sets ``left`` and ``right`` of a pair differ.

    ``side`` is 1 for digests of the left set only and -1 for the right. Without ``keep`` there is one row for each side
    with the number ``n`` of digests. ``keys`` name a pair. The first sketch has ``CELLS`` times as many cells as the
    pair has digests; pairs whose peeling ends with cells left are tried with twice the size and new hashes, and after
    ``ATTEMPTS`` doublings compared digest by digest.
    """
    recovered, todo = None, pairs.select(*keys, "left", "right")
    for attempt in range(ATTEMPTS):
        width = F.ceil((F.size("left") + F.size("right")) * (CELLS * 2 ** attempt / TABLES)) + BASE_WIDTH
        sides = todo.select(*keys, width.alias("width"), F.inline(F.array(
            F.struct(F.lit(1).cast("long").alias("sign"), F.col("left").alias("digests")),
            F.struct(F.lit(-1).cast("long").alias("sign"), F.col("right").alias("digests")))).alias("sign", "digests"))
        digests = sides.select(*keys, "width", "sign", F.explode("digests").alias("digest"))
        peeled = materialise(_peel(_cells(digests, keys, attempt).filter("n <> 0 OR key <> 0 OR check <> 0"), keys, attempt, keep), "sketch-peeled")
        failed = peeled.filter("side = 0").select(*keys).distinct()
        done = peeled.filter("side <> 0").select(*keys, F.col("slot").alias("digest"), "side", "n")
        if failed.isEmpty():
            return done if recovered is None else recovered.union(done)
        failed = materialise(failed, "sketch-failed")
        done = done.join(failed, keys, "left_anti")
        recovered = done if recovered is None else recovered.union(done)
        todo = pairs.join(failed, keys, "left_semi").select(*keys, "left", "right")
    rest = todo.select(*keys, F.explode(F.array_except("left", "right")).alias("digest"), F.lit(1).cast("long").alias("side"), F.lit(1).cast("long").alias("n")).union(
        todo.select(*keys, F.explode(F.array_except("right", "left")).alias("digest"), F.lit(-1).cast("long").alias("side"), F.lit(1).cast("long").alias("n")))
    return recovered.union(rest)


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Number of the first bound that is not below the id, as a balanced tree of comparisons; NULL goes to 0."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(doc_id <= bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(tree(0, len(bounds) - 1)) if bounds else F.lit(0)


def with_next(rows: DataFrame, parts: int, derived: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` (doc_id, ...) with dest, rid and ``next``, the row that follows in descending doc_id; the first follows the last.

    ``derived`` columns are made once the rows are dealt, so they take no room in the shuffle.

    Null ids come last, equal ids in the order of their texts. Rows are dealt by quantiles of the ids, which are ids
    of the table, so the first row of each range is known and also sent, as a guest, to the range that ends before it.
    """
    stats = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit((i + 1) / parts) for i in range(parts)]), F.lit(10_000)).alias("b"),
                     F.max("doc_id").alias("top")).first()
    bounds = sorted({*(stats.b or []), stats.top} - {None})
    own = _bucket(F.col("doc_id"), bounds)
    heads = F.col("doc_id").isin(bounds) if len(bounds) <= 1 else F.array_contains(F.lit(bounds), F.col("doc_id"))
    dealt = rows.select("*", F.posexplode(F.when(F.coalesce(heads, F.lit(False)), F.array(own, (own + 1) % max(1, len(bounds)))).otherwise(
        F.array(own))).alias("guest", "dest"))
    if derived:
        dealt = dealt.repartition("dest").withColumns(derived)
    order = Window.partitionBy("dest").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    names = [*rows.columns, *(derived or {})]
    follow = F.lead(F.struct(*names)).over(order)
    if not bounds:  # no ids at all: one range, whose first row follows its last
        follow = F.coalesce(follow, F.first(F.struct(*names)).over(order))
    return (dealt.withColumn("next", follow).withColumn("rid", F.row_number().over(order).cast("long"))
            .filter("guest = 0").drop("guest"))


def fingerprint_text(digests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint): the cells of the base sketch of (keys, digest) rows as text, in the order of the cells."""
    cells = _cells(digests.select(*keys, F.lit(BASE_WIDTH).cast("long").alias("width"), "digest", F.lit(1).cast("long").alias("sign")), keys, 0)
    part = F.concat_ws(".", F.hex("slot"), F.hex("n"), F.hex("key"), F.hex(F.col("check").bitwiseAND(0xFFFFFFFF)))
    return cells.groupBy(*keys).agg(F.concat_ws("-", F.transform(
        F.array_sort(F.collect_list(F.struct("slot", part.alias("t")))), lambda s: s["t"])).alias("fingerprint"))


def version_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = PARAGRAPH) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last half of the code points replaced by as many of the next document's first ones.
    Likeness is the Jaccard similarity of the paragraph sets, from the digests that peeling recovers; two texts without
    paragraphs are alike. ``unit`` is the pattern of a paragraph. A null text is empty, a table of one row follows itself.
    """
    spark = docs.sparkSession
    parts = 4 * shuffle_width(spark)  # small enough for the aggregations of a bucket to stay in memory
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    dealt = with_next(rows, parts, {"own": paragraph_digests(F.col("text"), unit)})
    made = (dealt.select("dest", "rid", "doc_id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("after"), edited.alias("text"))
            .select("dest", "rid", "doc_id", "n_chars", "own", "after", F.sha2("text", 256).alias("edited_sha256"),
                    paragraph_digests(F.col("text"), unit).alias("edited")))
    # bucketed by dest as it is already dealt: what follows groups within a row and needs no shuffle
    name = f"sketch_{uuid.uuid4().hex}"
    made.write.bucketBy(parts, "dest").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    made = spark.table(name)
    keys = ["dest", "rid"]
    pairs = made.select(*keys, F.inline(F.array(
        F.struct(F.lit(0).alias("pair"), F.col("own").alias("left"), F.col("edited").alias("right")),
        F.struct(F.lit(1).alias("pair"), F.col("own").alias("left"), F.col("after").alias("right")))).alias("pair", "left", "right"))
    differ = differences(pairs, [*keys, "pair"], keep=False).groupBy(*keys).agg(
        *[F.sum(F.when((F.col("pair") == p) & (F.col("side") == s), F.col("n"))).alias(f"d{p}{'lr'[s < 0]}") for p in (0, 1) for s in (1, -1)])
    versions = made.select(*keys, F.inline(F.array(
        F.struct(F.lit(0).alias("version"), F.col("own").alias("digests")),
        F.struct(F.lit(1).alias("version"), F.col("edited").alias("digests")))).alias("version", "digests"))
    prints = fingerprint_text(versions.select(*keys, "version", F.explode("digests").alias("digest")), [*keys, "version"]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("version") == v, F.col("fingerprint"))).alias(c) for v, c in ((0, "fingerprint"), (1, "edited_fingerprint"))])

    def near(pair: int) -> Column:
        left, right = (F.coalesce(F.col(f"d{pair}{s}"), F.lit(0)) for s in "lr")
        union = F.col("own_size") + right
        return F.when(union == 0, F.lit(1.0)).otherwise((F.col("own_size") - left) / union)

    base = made.select(*keys, "doc_id", "n_chars", "edited_sha256", F.size("own").alias("own_size"))
    none = F.lit("")  # a text without paragraphs has no cells
    return (base.join(differ, keys, "left").join(prints, keys, "left")
            .select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", F.coalesce("fingerprint", none).alias("fingerprint"),
                    F.coalesce("edited_fingerprint", none).alias("edited_fingerprint"), near(0).alias("near_edited"), near(1).alias("near_next")))
