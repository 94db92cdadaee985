"""Small helpers that several operations share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.operators.shipping import ship
from gridkin.operators.storage import write_and_read

# The white space that separates words, as a Java and Python pattern.
SPACES = r"[\x20\x09-\x0D]+"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, or with underscores before it until no column has that name."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(_returning_memory(function), schema)


def _return_memory() -> None:
    """A worker lives on after its task; what its allocators keep for later would count against the next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def _returning_memory(function: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _return_memory()

    return run


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Jobs run meanwhile hand rows to Python so many at a time: for rows of some kilobytes each."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def stored_in_small_batches(df: DataFrame, name: str) -> DataFrame:
    """``write_and_read`` of what Python makes of large rows."""
    with small_batches(df.sparkSession):
        return write_and_read(df, name)


def map_groups(
    df: DataFrame, keys: list[str], function: Callable[[tuple, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``groupBy(keys).applyInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return function(key, table)
        finally:
            _return_memory()

    return df.groupBy(*keys).applyInArrow(run, schema)


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(doc_id: Column | str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4.

    A null id counts as the empty text.
    """
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def ragged_gather(
    values: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of ``values[s : s + n]`` for all (s, n), and where each part ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - lengths), lengths)
    return values[np.arange(total) + shift], ends


def in_slices(
    batches: Iterator[pa.RecordBatch], rows: int = 256, column: int | None = None, most: int = 2 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows some hundred at a time, where a row may be large in Python.

    With ``column``, a text or binary one, a slice also ends before it holds more than ``most`` bytes of it;
    a longer value is a slice of its own.
    """
    for batch in batches:
        if column is None:
            edges = [*range(0, batch.num_rows, rows), batch.num_rows]
        else:
            edges, size = [0], 0
            for i, n in enumerate(pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)):
                size += int(n)
                if i > edges[-1] and (size > most or i - edges[-1] == rows):
                    edges.append(i)
                    size = int(n)
            edges.append(batch.num_rows)
        for start, end in zip(edges, edges[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)
