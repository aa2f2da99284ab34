"""Small shared helpers of the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.session import scratch_path

#: ASCII white space, the class ``[\x20\x09-\x0D]``.
SPACE = b" \t\n\x0b\x0c\r"


#: Rows of a narrow intermediate table that are worth a task of their own, and tasks at least.
TASK_ROWS, LEAST_TASKS = 100_000, 12


def tasks_for(rows: int) -> int:
    """Tasks for a narrow table of at most so many rows."""
    return max(LEAST_TASKS, -(-rows // TASK_ROWS))


def materialize(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` to a fresh Parquet table in the shared checkpoint folder and read it back.

    ``tasks`` folds the shuffle partitions of a small table into so many tasks and files (more than
    there are partitions changes nothing); iterations over small tables then cost no more than their rows.
    Cuts lineage with files every executor can reach, so losing one loses nothing;
    column pruning and size statistics (for broadcast decisions) come with the format.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def binary_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, starting at 0) and the bytes of a binary or string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buffers[2], np.uint8, last - first, first) if buffers[2] is not None and last > first else np.zeros(0, np.uint8)
    return offsets - first, data


def slices(offsets: np.ndarray, limit: int):
    """Row ranges [i, j) of about ``limit`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... for each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


#: Documents in an Arrow batch at most: batches hold whole texts, in the JVM, on the way and in Python.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches lowered to BATCH_ROWS rows (never raised): Spark counts a
    batch's rows and not its bytes, and its default of 10,000 whole texts is too much for a small executor."""
    spark = df.sparkSession
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return df


def release_memory() -> None:
    """Give freed memory back to the system: Spark reuses Python workers, and allocators keep what a finished task held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """``run`` (batches to batches), after which the worker's free memory is released."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: A bitmap for ``may_contain`` has at most so many bits: 16 MB, whatever the number of keys.
MAX_BITS = 1 << 27


def key_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bytes of a bitmap with bit (key mod size) set for each 64-bit key of ``column``.

    Its size follows the number of keys, 32 bits for each, up to MAX_BITS; past that it only lets
    more other keys through.  Spark builds it in 4 KB pieces, so at most MAX_BITS / 8 bytes come
    to the driver.
    """
    n = keys.count()
    bits = 1 << 18
    while bits < min(32 * n, MAX_BITS):
        bits *= 2
    at = keys.select((F.pmod(F.col(column), F.lit(bits)) + 1).alias("at"))
    pieces = at.groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in pieces.collect():
        piece = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[(row["piece"] - 1) * 4096:][:len(piece)] = piece
    return out


def may_contain(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a 64-bit key is certainly not among those of the bitmap."""
    at = keys.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def shielded(df: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """``df`` under column names that no helper column can clash with, and the new names of the columns ``used``.

    ``.toDF(*df.columns)`` gives the result its own names back.
    """
    names = [f"col{i}" for i in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(c)] for c in used]
