"""Fill-in-the-middle texts, put together from pieces by a secondary sort.

Each document is cut into prefix, middle and suffix and leaves the scan as pieces of bounded length, keyed by document
and place in the output. One shuffle by document with a sort by (document, place) brings the pieces of a document to one
task in output order, where they stream into an incremental digest (or into the text); no task holds a document of
pieces. The output pieces are then sorted again by their original place, in the same partitions, and stream into the
digest of the restored text.

Documents are told apart by the scan partition, id, length and hash of their text; equal rows of one scan partition share pieces, which are
counted. So a lost task that is run again gives the same keys, and equal rows of many partitions do not meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.common import arrow_map, ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 16_384  # code points of a piece
DOCUMENT = ["part", "doc_id", "chars", "text_hash"]
PIECES = "part int, doc_id long, chars long, text_hash long, place int, origin int, piece string, form string, prefix_chars long, middle_chars long"
HEAD = -1  # place and origin of the row that describes a document


def cuts(text: str, unit: str | None) -> list[int] | range:
    """Code point offsets at which a unit may end, from 0 to the end of the text; without a pattern a unit is a code point.

    What follows the last match, or lies between two, belongs to the unit after it.
    """
    if unit is None:
        return range(len(text) + 1)
    ends = [m.end() for m in regex.finditer(unit, text) if m.end() > m.start()]
    return [0, *ends] + ([len(text)] if text and (not ends or ends[-1] < len(text)) else [])


def plan(doc_id: int | None, text: str, unit: str | None = None, seed: int = 1, plain: int = 90, spm: int = 20) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text in code points, drawn from its id alone; a null id is ''."""
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return "plain", 0, 0
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * k: 8 * k + 8], 16) for k in range(4)]
    if h[2] % 100 >= plain:
        return "plain", 0, 0
    ends = cuts(text, unit)
    a, b = sorted((h[0] % len(ends), h[1] % len(ends)))
    return "spm" if h[3] % 100 < spm else "psm", ends[a], ends[b]


def ordered(form: str, text: str, a: int, b: int) -> list[tuple[int, str, int, int]]:
    """(original rank, mark, start, end) of the sections in output order."""
    if form == "plain":
        return [(0, "", 0, len(text))]
    prefix, middle, suffix = (0, PREFIX, 0, a), (1, MIDDLE, a, b), (2, SUFFIX, b, len(text))
    return [suffix, prefix, middle] if form == "spm" else [prefix, suffix, middle]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | None = None, seed: int = 1,
           plain: int = 90, spm: int = 20, piece: int = PIECE) -> DataFrame:
    """One row that describes a document (place -1), then its output in pieces; a null text is empty."""
    def run(batch):
        columns = {name: [] for name in ("part", "doc_id", "chars", "text_hash", "place", "origin", "piece", "form", "prefix_chars", "middle_chars")}
        add = [c.append for c in columns.values()]
        for part, doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            form, a, b = plan(doc_id, text, unit, seed, plain, spm)
            place = HEAD
            rows = [(HEAD, None, form, None if form == "plain" else a, None if form == "plain" else b - a)]
            for rank, mark, start, end in ordered(form, text, a, b):
                step = piece if end > start else 1
                rows += [(rank, (mark if at == start else "") + text[at: min(end, at + step)], None, None, None)
                         for at in (range(start, end, step) if end > start else (start,))]
            for origin, out, kind, n_prefix, n_middle in rows:
                for put, value in zip(add, (part, doc_id, len(text), text_hash, place, origin, out, kind, n_prefix, n_middle), strict=True):
                    put(value)
                place += 1
        return columns

    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, PIECES, rows=1024)


def by_output(rows: DataFrame) -> DataFrame:
    """The pieces dealt by document and sorted by their place in the output: repartition and sort within partitions."""
    return rows.repartition(*DOCUMENT).sortWithinPartitions(*DOCUMENT, "place")


class Documents:
    """Streams sorted pieces: ``head`` begins a document, ``piece`` takes each piece once, ``end`` closes it with its copies."""

    def __init__(self, order: str):
        self.order, self.key, self.at, self.copies = order, None, None, 0

    def feed(self, batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = batch.schema.names
            values = [c.to_pylist() for c in batch.columns]
            keys = list(zip(*(values[names.index(n)] for n in DOCUMENT), strict=True))
            for key, at, row in zip(keys, zip(values[names.index(self.order)], values[names.index("place")], strict=True),
                                    zip(*values, strict=True), strict=True):
                if key != self.key:
                    if self.key is not None:
                        yield from self.end()
                    self.key, self.at, self.copies = key, at, 1
                    self.head(dict(zip(names, row, strict=True)))
                elif at == self.at:  # the same piece of an equal row
                    self.copies += at[1] == HEAD
                    continue
                else:
                    self.at = at
                    yield from self.piece(dict(zip(names, row, strict=True)))
            yield from self.flush()
        if self.key is not None:
            yield from self.end()
        yield from self.flush()

    def head(self, row): ...

    def piece(self, row): return ()

    def end(self): return ()

    def flush(self): return ()


class Collected(Documents):
    """Collects output rows and hands them on as Arrow batches."""

    def __init__(self, order: str, schema: pa.Schema, rows: int = 4096):
        super().__init__(order)
        self.schema, self.rows, self.out = schema, rows, []

    def put(self, row: tuple):
        self.out.append(row)
        if len(self.out) >= self.rows:
            yield from self.flush()

    def flush(self):
        if self.out:
            columns = list(zip(*self.out, strict=True))
            self.out = []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


class Digester(Collected):
    """First pass, in output order: digest of the output, then the pieces without marks, to be sorted by origin."""

    def head(self, row):
        self.row, self.output, self.count = row, hashlib.sha256(), [0, 0, 0]

    def piece(self, row):
        text = row["piece"]
        self.output.update(text.encode())
        if self.row["form"] != "plain":
            for rank, mark in enumerate((PREFIX, MIDDLE, SUFFIX)):
                if text.startswith(mark):  # no mark is in a text of this form, so it begins a section
                    self.section, text = rank, text[len(mark):]
                    break
        else:
            self.section = 0
        self.count[self.section] += 1
        yield from self.put((*self.key, self.count[self.section], self.section, text, None, None, None, None, 1))

    def end(self):
        r = self.row
        yield from self.put((*self.key, HEAD, HEAD, None, r["form"], r["prefix_chars"], r["middle_chars"], self.output.hexdigest(), self.copies))


class Restorer(Collected):
    """Second pass, in original order: digest of the restored text and one row for each copy of the document."""

    def head(self, row):
        self.row, self.restored = row, hashlib.sha256()

    def piece(self, row):
        self.restored.update(row["piece"].encode())
        return ()

    def end(self):
        r = self.row
        row = (r["doc_id"], r["chars"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], self.restored.hexdigest())
        for _ in range(r["copies"]):
            yield from self.put(row)


class Writer(Collected):
    """Output texts themselves."""

    def head(self, row):
        self.row, self.text = row, []

    def piece(self, row):
        self.text.append(row["piece"])
        return ()

    def end(self):
        for _ in range(self.copies):
            yield from self.put((self.row["doc_id"], self.row["form"], self.row["prefix_chars"], self.row["middle_chars"], "".join(self.text)))


RESTORED = PIECES + ", output_sha256 string, copies long"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
TEXTS = "doc_id long, form string, prefix_chars long, middle_chars long, output string"


def _stream(rows: DataFrame, kind: type[Collected], order: str, ddl: str, batch: int = 4096) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    ship(rows.sparkSession)
    return rows.mapInArrow(lambda batches: kind(order, schema, batch).feed(batches), ddl)


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, form, prefix_chars, middle_chars, output) of every row; options are those of ``pieces``.

    Form, cuts and output depend on id and text only. Empty and null texts are plain and stay empty; texts that contain a
    mark are plain. Equal rows all come back; a null id draws its cuts from the empty string; other columns are left
    alone; an empty table gives an empty result.
    """
    return _stream(by_output(pieces(docs, **options)), Writer, "place", TEXTS, 64)


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): outputs and what they restore to.

    The second sort is inside the partitions of the first, so texts are shuffled once.
    """
    out = _stream(by_output(pieces(docs, **options)), Digester, "place", RESTORED, 256)
    return _stream(out.sortWithinPartitions(*DOCUMENT, "origin", "place"), Restorer, "origin", DIGESTS)
