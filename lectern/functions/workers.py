"""Rows through Python workers, where no built-in expresses an operator.

What a worker holds at once is bounded: Spark sends at most ``BATCH_ROWS`` rows or about ``BATCH_BYTES`` bytes, of which
``slices`` takes about ``SLICE_BYTES`` at a time, and what a task took is given back when it ends, as workers outlive tasks.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

#: Bounds on one Arrow batch, and on the part of it that a function sees at once.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 1000, 8 << 20, 1 << 20


def bounded_batches(spark) -> None:
    """Ship the package and bound the Arrow batches of this session, for all operators that run Python."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def return_memory() -> None:
    """Give freed memory back to the machine: an idle worker keeps what its tasks took otherwise, next to the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, about ``most`` bytes at a time, one row at least; memory goes back at the end."""
    for b in batches:
        step = max(1, b.num_rows * most // max(b.nbytes, 1))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)
    return_memory()


def arrow_rows(df: DataFrame, fn: Callable, schema: str, columns: list[str]) -> DataFrame:
    """``fn`` of each row's values to a tuple of the schema's columns, in Arrow batches."""
    bounded_batches(df.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def body(batches):
        for b in slices(batches):
            cols = list(zip(*[fn(*r) for r in zip(*(c.to_pylist() for c in b.columns))]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(cols, kinds)], names=kinds.names)

    return df.select(*columns).mapInArrow(body, schema)


def arrow_map(df: DataFrame, fn: Callable, schema: str, *columns: str) -> DataFrame:
    """``fn`` of each batch's Arrow columns to a list of columns of ``schema``, all of one length."""
    bounded_batches(df.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def body(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([c.cast(k.type) if isinstance(c, pa.Array) else pa.array(c, type=k.type) for c, k in zip(fn(*b.columns), kinds)], names=kinds.names)
        return_memory()

    return df.select(*columns).mapInArrow(body, schema)
