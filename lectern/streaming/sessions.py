"""Sessions of a stream that expire: their state goes when they end, and what is told is whole sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import SESSION_TTL
from ..sources.stores import sweep_sessions
from .ordered import InOrder, ordered_stream


class _Sessions(InOrder):
    alarms = True

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def open(self, handle) -> None:
        self.session = handle.getValueState("session", "first long, last long, touches long")

    def take(self, key, rows, known):
        was = self.session.get()
        first, last, touches = was or (None, None, 0)
        ended = []
        for r in rows:
            if first is not None and r["us"] - last >= self.ttl:
                ended.append((key[0], first, last, touches))
                first = None
            if first is None:
                first, touches = r["us"], 0
            last, touches = r["us"], touches + 1
        if first is not None and last + self.ttl <= known:  # a touch at that very time would have been a new session's
            ended.append((key[0], first, last, touches))
            first = None
        if first is not None:
            self.session.update((first, last, touches))
        elif was:
            self.session.clear()
        return ended, None if first is None else last + self.ttl


def expiring_sessions(events: DataFrame, key: str, ts: str, ttl: int = SESSION_TTL, late: str = "10 minutes", drop_late: bool = False) -> DataFrame:
    """(key, first, last, touches) of each session of a stream when it has ended: ``ttl`` seconds after its last touch.

    A touch exactly ``ttl`` after the one before opens a new session, so Spark's windows, which take in a touch at their very
    end, are a microsecond shorter. State is a row for each session that is not over. Of the rows later than ``late`` only those
    are dropped whose own session would be over; one that belonged to a session already told opens another. With ``drop_late`` all of
    them are dropped, by a buffer that waits for the watermark row by row and takes many times as long.
    """
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("at"), "event_id")
    if drop_late:
        ended = ordered_stream(rows, "key", "at", late, _Sessions(ttl), "key long, first long, last long, touches long")
        return ended.select("key", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "touches")
    window = F.session_window("at", f"{ttl * 1_000_000 - 1} microseconds")
    ended = rows.withWatermark("at", late).groupBy("key", window).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("touches"))
    return ended.select("key", "first", "last", "touches")


def sweep_with(read, write):
    """A ``foreachBatch`` function for ended sessions: their documents go or lose them, as a sweep does.

    ``read()`` gives the documents (doc_id, session_id, owner, ...), ``write(documents)`` takes what is left. A batch that
    is run again finds nothing more to sweep.
    """

    def batch(ended: DataFrame, _: int) -> None:
        over = ended.select(F.col("key").alias("session_id")).distinct().withColumn("expires_at", F.lit(0))
        if not over.isEmpty():
            write(sweep_sessions(over, read(), F.lit(0))[1])

    return batch
