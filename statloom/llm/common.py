"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.session import cut_lineage, quoted

__all__ = ["cut_lineage", "quoted"]

#: Bytes of text that a batch function works on at a time.
SLICE_BYTES = 2 << 20
#: Rows of a batch that holds texts.
BATCH_ROWS = 500
#: Elements of a block of running folds.
FOLD_BLOCK = 128


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def long_texts(df: DataFrame) -> DataFrame:
    """The same rows; batches for Python hold at most BATCH_ROWS of them from now on, as texts can be long."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def fresh(df: DataFrame | list[str], *names: str) -> list[str]:
    """Each name, with underscores in front where a column has it, whatever the case."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def worker_store(name: str) -> dict:
    """A dict that lives as long as the worker process, whatever the tasks it serves."""
    home = sys.modules.setdefault("_statloom_worker_store", types.ModuleType("_statloom_worker_store"))
    return home.__dict__.setdefault(name, {})


class Scratch:
    """Tables below the folder of `spark.checkpoint.dir`, to cut lineage.

    Unlike a checkpoint, a table's size is known to the planner; estimates of a
    plan that a loop goes on with would multiply at each join.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if folder is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="statloom-checkpoint-"))
            folder = spark.sparkContext.getCheckpointDir()
        self.folder = folder.rstrip("/")

    def settle(self, df: DataFrame) -> DataFrame:
        """Write `df` and read it back."""
        path = f"{self.folder}/statloom-{uuid.uuid4()}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Empty all tables written so far."""
        for path in self.paths:
            self.spark.range(0).write.mode("overwrite").parquet(path)
        self.paths = []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column and where each begins; NULL is empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, width = (np.int64, 8) if large else (np.int32, 4)
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(ends, kind, len(column) + 1, column.offset * width).astype(np.int64)
    first, last = int(starts[0]), int(starts[-1])
    held = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return held, starts - first


def row_slices(starts: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes, at least a row each."""
    row, rows = 0, len(starts) - 1
    while row < rows:
        end = int(np.searchsorted(starts, starts[row] + limit, "right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end
        row = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit words over all bits (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < count."""
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:count]


def row_key(*columns: str | Column) -> Column:
    """A 64-bit key of a row's content, NULL told from empty."""
    parts: list[Column] = []
    for c in columns:
        c = F.col(quoted(c)) if isinstance(c, str) else c
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once; inside a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_before(z: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array the fold of the values of all earlier ones, from 0.

    Taken over blocks of FOLD_BLOCK elements first, so that the work is no square of the array's size.
    """
    zero = F.lit(0)
    fold = lambda part: F.aggregate(part, zero, lambda a, e: combine(a, value(e)))
    block = lambda i: F.floor(i / FOLD_BLOCK).cast("int")

    def placed(earlier: Column) -> Column:
        return F.transform(z, lambda _, i: combine(F.get(earlier, block(i)), fold(F.slice(z, block(i) * FOLD_BLOCK + 1, i % FOLD_BLOCK))))

    def summed(blocks: Column) -> Column:
        earlier = F.transform(blocks, lambda _, k: F.aggregate(F.slice(blocks, F.lit(1), k), zero, combine))
        return let(earlier, placed)

    blocks = F.transform(F.sequence(zero, block(F.size(z) - 1)), lambda k: fold(F.slice(z, k * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK))))
    return F.when(F.size(z) > 0, let(blocks, summed)).otherwise(F.array().cast("array<int>"))
