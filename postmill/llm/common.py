"""Small helpers shared by the operators: scratch tables, text batches, per-worker state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_dir, shared_dir

#: Rows of text handled at once inside a task, and their bytes unless one row alone has more.
SLICE_ROWS = 256
SLICE_BYTES = 4 << 20


#: The scratch folders to be removed by the ``collected`` block that is open.
_COLLECTED: ContextVar[list[Scratch] | None] = ContextVar("collected", default=None)


class Scratch:
    """Tables written below ``spark.checkpoint.dir`` to cut lineage.

    ``cut`` writes a frame and reads it back, so a lost executor costs no more than the
    tasks it was running. ``drop`` removes tables that nothing reads any longer. What an
    operator returns is lazy and reads its tables when it is written: a caller that writes it
    inside a ``collected`` block leaves none of them behind.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables = spark, shared_dir(spark, name), 0
        held = _COLLECTED.get()
        if held is not None:
            held.append(self)

    def cut(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.tables += 1
        path = f"{self.root}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for path in paths:
            remove_dir(self.spark, path)

    def close(self) -> None:
        """Remove all of its tables."""
        self.drop(self.root)


@contextmanager
def collected() -> Iterator[None]:
    """Scratch tables that are made inside go at the end: write what reads them before that."""
    held: list[Scratch] = []
    before = _COLLECTED.set(held)
    try:
        yield
    finally:
        _COLLECTED.reset(before)
        for scratch in held:
            scratch.close()


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str,
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Arrow batches in short slices, each with its texts as Python strings."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(ends):
            before = ends[start] - sizes[start]
            fitting = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
            stop = min(max(fitting, start + 1), start + SLICE_ROWS)
            part = batch.slice(start, stop - start)
            yield part, part.column(column).to_pylist()
            start = stop


def per_worker(state: Broadcast, key: str, build: Callable[[dict], object]):
    """An object built once per Python worker and kept beside the broadcast dictionary.

    Task functions travel by value, so their module globals start afresh in every task;
    a broadcast value lives as long as the worker.
    """
    held = state.value
    if key not in held:
        held[key] = build(held)
    return held[key]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts without other letters take the quicker built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def held_out(doc_id: Column) -> Column:
    """The fold kept away from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
