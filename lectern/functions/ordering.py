"""Running aggregates over long orders: each partition of a range sort is scanned alone, what it passes on is carried by a
small second table, so that a key with most of the rows is no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` range-sorted by the columns in a written table, with ``_part`` and ``_at``, which grow in that order.

    Equal rows are parted by their place in the input too, which is the same whenever a task runs again.
    """
    df = df.withColumn("_input", F.monotonically_increasing_id())
    ranged = df.repartitionByRange(*columns, "_input").sortWithinPartitions(*columns, "_input").drop("_input")
    return materialise(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))


def spans_of(ordered: DataFrame, key: str, **totals) -> DataFrame:
    """(key, _part, _n, _first, totals..., _before): what each partition holds of each key, and the rows of the key before it."""
    spans = ordered.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), *[c.alias(name) for name, c in totals.items()])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def join_spans(ordered: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The rows with what their span knows; null keys meet. A span is a part of one partition, so no key is hot here."""
    spans = spans.withColumnRenamed(key, "_key").withColumnRenamed("_part", "_of")
    return ordered.join(spans, (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key"))).drop("_key", "_of")
