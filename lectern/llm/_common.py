"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.functions.workers import bounded_batches, return_memory
from lectern.session import discard, materialise, release_shuffles, ship, table  # noqa: F401  re-exported for the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six characters that part words.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` range-sorted by the columns, with ``_at``, which grows in that order: the partition above 33 bits, the row below.

    Equal rows are parted by their place in the input too, so that many copies share several partitions; that place is the
    same whenever a task runs again. Write the result before using ``_at`` twice.
    """
    df = df.withColumn("_input", F.monotonically_increasing_id())
    ranged = df.repartitionByRange(*columns, "_input").sortWithinPartitions(*columns, "_input")
    return ranged.drop("_input").withColumn("_at", F.monotonically_increasing_id())


_models: dict[tuple, object] = {}


def worker_model(key: tuple, make):
    """``make()``, kept by this worker process under ``key`` until another model or another operator takes over."""
    if key not in _models:
        _models.clear()
        _models[key] = make()
    return _models[key]


def release_models(owner: str) -> None:
    """Drop models that other operators than ``owner`` left in this worker, which outlives stages."""
    if any(k[0] != owner for k in _models):
        _models.clear()


def arrow_stream(df: DataFrame, body, schema: str, *columns: str) -> DataFrame:
    """mapInArrow over the named columns: ``body`` gets an iterator over the columns of each batch of a task and yields
    lists of Arrow arrays or sequences, one per column of ``schema``."""
    bounded_batches(df.sparkSession)
    kinds = list(to_arrow_schema(StructType.fromDDL(schema)))
    owner = body.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_models(owner)
        for out in body(batch.columns for batch in batches):
            arrays = [x.cast(k.type) if isinstance(x, pa.Array) else pa.array(x, type=k.type) for x, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[k.name for k in kinds])
            del out, arrays
        return_memory()

    return df.select(*columns).mapInArrow(run, schema)


def arrow_map(df: DataFrame, fn, schema: str, *columns: str) -> DataFrame:
    """mapInArrow over the named columns: ``fn`` gets each batch's columns as Arrow arrays and returns a list of
    arrays or Python lists, one per column of ``schema`` (all of one length, which need not be the batch's)."""

    def body(batches):
        for columns_ in batches:
            yield fn(*columns_)

    body.__module__ = fn.__module__
    return arrow_stream(df, body, schema, *columns)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def bitmap_size(rows: int) -> int:
    """Bits, as a power of two, of a bitmap of so many values: eight a value, from 128 KB up to 16 MB."""
    return min(27, max(20, (8 * rows).bit_length()))


def bitmap_of(df: DataFrame, column: str, log2_bits: int = 23) -> np.ndarray:
    """A one-hash membership bitmap over a long column of well-mixed values.

    Its size is fixed by ``log2_bits`` (1 MB at 23) whatever the rows, so it may be broadcast; it only
    ever lets too much through, never too little. Rows reach the driver as at most ``2 ** (log2_bits - 6)``
    machine words.
    """
    word = F.shiftrightunsigned(F.col(column), 64 - (log2_bits - 6))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    rows = df.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value (uint64) may be in the bitmap."""
    shift = np.uint64(64 - int(np.log2(len(bitmap))))
    return (bitmap[(values >> shift).astype(np.int64)] >> (values & np.uint64(63))) & np.uint64(1) == 1
