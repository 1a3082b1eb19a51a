"""Workers as running queries, and the beats by which others see that they are alive."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

# Fixed values, in seconds: between looks for work, and the age of the last beat from which a worker counts as gone.
POLL, MAX_AGE = 1, 60
BEAT = "name string, run string, batch long, at double"


class Heartbeat(StreamingQueryListener):
    """Writes one small file a query under ``folder``, a place that all of the cluster sees: at its start, after every
    batch, and while it finds nothing to do. A query that has ended beats no more."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), {}

    def _beat(self, run: str, name: str, batch: int) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        out.write((json.dumps({"name": name, "run": run, "batch": batch, "at": time.time()}) + "\n").encode())
        out.close()

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self._beat(str(event.runId), self.names[str(event.runId)], -1)

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self._beat(run, self.names.get(run, str(event.progress.id)), event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        run = str(event.runId)
        self._beat(run, self.names.get(run, str(event.id)), -1)

    def onQueryTerminated(self, event) -> None:
        self.names.pop(str(event.runId), None)


def beats(spark: SparkSession, folder: str, now: float | None = None, max_age: float = MAX_AGE) -> DataFrame:
    """(name, run, batch, at, age, alive) of every query that has ever beaten under ``folder``."""
    now = time.time() if now is None else now
    told = spark.read.schema(BEAT).json(folder)
    return told.withColumn("age", F.lit(now) - F.col("at")).withColumn("alive", F.col("age") <= max_age)


def work(source: DataFrame, name: str, take: Callable[[DataFrame, int], None], checkpoint: str, every: float = POLL) -> StreamingQuery:
    """A worker: what a streaming ``source`` brings is handed to ``take`` in batches, with a look for more ``every`` seconds.

    A batch that was not finished is handed over again after a restart, under the same number.
    """
    return source.writeStream.queryName(name).foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{name}").trigger(processingTime=f"{every} seconds").start()


def work_queues(sources: dict[str, DataFrame], takes: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, every: float = POLL) -> list[StreamingQuery]:
    """A worker for each queue; they run side by side, and one that fails does not stop the others."""
    return [work(source, name, takes[name], checkpoint, every) for name, source in sources.items()]
