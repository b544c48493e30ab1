"""Small helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession

#: Output batches are closed at about this many bytes or rows.
FLUSH_BYTES, FLUSH_ROWS = 8 << 20, 4096


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's texts, a NULL as an empty one."""
    return [t or "" for t in batch.column(name).to_pylist()]


class Rows:
    """Collects output rows and gives them out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self._clear()

    def _clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema.names]
        self.bytes = 0

    def add(self, row: Sequence, size: int = 0) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes >= FLUSH_BYTES or len(self.columns[0]) >= FLUSH_ROWS

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self._clear()
        return out

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield self.take()


def slices(values: Sequence, sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about ``most``; a larger one stands alone."""
    start, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if i >= start:
        yield start, i + 1


Run = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(run: Run) -> Run:
    """The function of a task, giving back what the worker no longer holds when it ends: workers live on between tasks
    and stages, and what they keep adds up."""
    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = _trim()
            if trim is not None:
                trim(0)
    return tidied


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Spark hands rows to Python so many at a time: for actions on rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
