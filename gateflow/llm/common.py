"""What the operators share: stored intermediate tables, Arrow text access, hashes of byte ranges."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateflow.session import materialise, shared_folder

__all__ = ["arrow_map", "grouped", "holds", "materialise", "mixed", "numbered", "range_hash", "release", "salted", "shared_folder", "ship",
           "shuffle_width", "table", "text_bytes"]

_held: dict[str, Callable[[], None]] = {}


def holds(name: str, drop: Callable[[], None]) -> None:
    """Name what a Python worker keeps from task to task; ``drop`` lets it go."""
    _held[name] = drop


def release(*needed: str) -> None:
    """Let go of what tasks left in this Python worker, but for what ``needed`` names, and give freed memory back.

    Workers live on between tasks and operators, and neither Arrow's pool nor the C library returns freed memory by itself.
    """
    for name, drop in _held.items():
        if name not in needed:
            drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, so that their Python can import it."""
    context = spark.sparkContext
    if getattr(context, "_gateflow_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="gateflow-code-")  # read by the driver alone, which serves it
    with zipfile.ZipFile(f"{folder}/gateflow_code.zip", "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(f"{folder}/gateflow_code.zip")
    context._gateflow_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted(n: int, *columns: str):
    """Stable salt from 0 to n - 1 that spreads the rows of one key."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their exact rank from 0 in the order of some columns, without a sort in one task.

    Rows are dealt by ranges; the counts of the ranges tell each one the rank it starts at.
    """
    dealt = materialise(df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "numbered")
    held = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    before = held.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range")
            .withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str,
              rows: int | None = None, needs: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns columns (a dict), several of them, or None.

    ``rows`` cuts a batch into slices of so many rows before the call, which bounds what a call holds; ``needs`` names
    what the worker shall keep between tasks.
    """
    def run(batches):
        release(*needs)
        yield from columns_of(batches)
        release(*needs)

    def columns_of(batches):
        types = arrow_schema
        for whole in batches:
            step = rows or max(1, whole.num_rows)
            for at in range(0, whole.num_rows, step):
                out = fn(whole.slice(at, step))
                for columns in [out] if isinstance(out, dict) else out or ():
                    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=types.field(n).type)
                              for n, c in columns.items()]
                    yield pa.RecordBatch.from_arrays(
                        [a.cast(types.field(n).type) if a.type != types.field(n).type else a
                         for n, a in zip(columns, arrays, strict=True)], names=list(columns))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each key; callers keep keys small by blocks or salts."""
    def run(rows: pa.Table) -> pa.Table:
        out = fn(rows)
        if rows.nbytes > 1 << 20:
            release()
        return out

    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column as one array, and the bounds of its rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[bounds[0]: bounds[-1]], bounds - bounds[0]


# Odd multipliers of the two range hashes; the byte tables come from seeded generators.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = [np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
           for seed in (11, 12)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
holds("powers", _powers.clear)


def _power_arrays(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get(kind)
    if held is None or len(held[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        out = []
        for base in (_BASES[kind], pow(_BASES[kind], -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        held = _powers[kind] = tuple(out)
    return held


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class range_hash:  # noqa: N801
    """64-bit hashes of any byte ranges of one array, each in constant time after one pass."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        power, self.inverse = _power_arrays(kind, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[kind][data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def sliding(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n])
