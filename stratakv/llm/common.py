"""What the corpus operators share: batch access to text as bytes, and column checks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.session import materialize, prepare, scratch_dir, table

__all__ = ["byte_slices", "keyed_text", "lean", "materialize", "prepare", "scratch_dir", "spread_table", "table", "text_bytes", "texts_of"]

#: Bytes of text that one numpy pass works on; bounds memory whatever the batch holds.
SLICE_BYTES = 500_000


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's scan; if it has fewer partitions than there are cores (one small file), its rows are dealt to all of them.

    Texts cost far more to work on than to move. A table of many files is scanned as it is.
    """
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with null text read as empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offs, data = column.buffers()
    if offs is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` over runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    data, offs = text_bytes(column)
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


#: What operators keep in a worker from task to task, by operator: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def drop_others(own: str) -> None:
    for name, drop in KEPT.items():
        if name != own:
            drop()


def give_back() -> None:
    """Hand memory that is free but still held by the allocators back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that holds no tables of operators but ``own``, and no free memory once the task has ended.

    Workers outlive tasks and stages: what one operator leaves in them would stand beside the JVM's memory in all later
    stages, those without Python too.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(own)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
