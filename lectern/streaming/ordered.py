"""Stateful streams whose keys see their rows in order of time, whatever the order of arrival.

A row waits in its key's state until the watermark has passed it; then all rows that are due go through the machine in order
of time and id. So a shuffled log gives what the sorted one gives, and a query that starts again from its checkpoint
goes on where it was. These streams need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).

A call of the store costs as much as many rows, so the rows that a key gets in one batch wait as one text, a JSON object a line.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import scratch_folder, ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """A machine behind a buffer. Its rows are dicts with ``us`` (microseconds) and ``event_id``.

    ``open`` makes the machine's state; ``take`` gets the rows due, in order, and the time up to which all rows are known,
    and returns a list of results, tuples of the columns ``told``, and the time of its next alarm, or None.
    """

    #: Names of a result's columns, and whether ``take`` is called at its alarms, too, when no row is due.
    told: tuple[str, ...]
    alarms = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("waiting", "rows string")
        self.result = Row(*self.told)
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r.us, r.row) for r in rows]
        self.rows.appendValue(("\n".join(row for _, row in came),))
        self.handle.registerTimer(-(-min(us for us, _ in came) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = timerValues.getCurrentWatermarkInMs() * 1000
        lines = [(json.loads(line), line) for (text,) in self.rows.get() for line in text.split("\n")]
        due = sorted((r for r, _ in lines if r["us"] <= known), key=lambda r: (r["us"], r["event_id"]))
        later = [(r["us"], line) for r, line in lines if r["us"] > known]
        if due:
            self.rows.clear()
            if later:
                self.rows.appendValue(("\n".join(line for _, line in later),))
        out, alarm = self.take(key, due, known) if due or self.alarms else ([], None)
        wake = [us for us, _ in later] + ([] if alarm is None else [alarm])
        if wake:
            self.handle.registerTimer(-(-min(wake) // 1000))
        for r in out:
            yield self.result(*r)

    def close(self) -> None:
        pass


def ordered_stream(rows: DataFrame, key: str, at: str, late: str, machine: InOrder, out: str) -> DataFrame:
    """``machine`` over a stream, by key; rows later than ``late`` behind the newest are dropped by the watermark."""
    ship(rows.sparkSession)
    machine.told = tuple(StructType.fromDDL(out).names)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    row = F.to_json(F.struct(*[c for c in rows.columns if c not in (key, at)], us.alias("us")), {"ignoreNullFields": "false"})
    # The buffer compares times to the millisecond: rows of one millisecond are due together.
    marked = rows.select(key, at, us.alias("us"), row.alias("row")).withWatermark(at, late)
    return marked.groupBy(key).transformWithState(machine, outputStructType=out, outputMode="Append", timeMode="EventTime")


def replay(spark: SparkSession, rows: DataFrame, at: str, end: tuple, stream: Callable[[DataFrame], DataFrame], batches: int = 4) -> DataFrame:
    """What ``stream`` gives for a whole table, read as a stream of files in micro-batches, to the end.

    ``end`` is a last row whose time lets the watermark pass all others. A micro-batch has a file for each core. The result
    is the written table of the stream.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    home, cores = scratch_folder(spark), spark.sparkContext.defaultParallelism
    rows.repartition(batches * cores).write.parquet(f"{home}/in")
    spark.createDataFrame([end], rows.schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
    told = stream(session.readStream.schema(rows.schema).option("maxFilesPerTrigger", cores).parquet(f"{home}/in"))
    query = told.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/out")
    query.awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{home}/out")
