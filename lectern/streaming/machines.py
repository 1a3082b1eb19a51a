"""Streaming forms of the limiter, sessions and first-wins dedupe."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import LIMIT_WINDOW, SESSION_TTL, limit_step


def rate_limit_stream(requests: DataFrame, limit: int, window: int = LIMIT_WINDOW, forget: bool = True) -> DataFrame:
    """``rate_limit`` over a stream: the state of a client and bucket is its log of at most ``limit`` allowed times.

    With ``forget`` a log that is silent for the window, by the clock of the cluster, is forgotten; the stream then has
    a batch whenever that is due, so it never comes to rest.
    """
    if "bucket" not in requests.columns:
        requests = requests.withColumn("bucket", F.lit(None).cast("string"))

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        waits = [limit_step(log, int(us), limit, window * 1_000_000, 1_000_000) for us in rows["us"]]
        state.update((list(log),))
        if forget:
            state.setTimeoutDuration(window * 1000)
        out = pd.DataFrame({"event_id": rows["event_id"], "client": rows["client"], "bucket": rows["bucket"], "allowed": [w == 0 for w in waits], "retry_after": waits})
        yield out.astype({"client": "Int64"})

    keyed = requests.select("event_id", "client", "bucket", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return keyed.groupBy("client", "bucket").applyInPandasWithState(step, "event_id long, client long, bucket string, allowed boolean, retry_after int", "log array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def session_stream(events: DataFrame, key: str, ts: str, ttl: int = SESSION_TTL) -> DataFrame:
    """(key, event_id, session): touches of a stream numbered by session; a touch ``ttl`` seconds or more after the one before opens a new one.

    The state of a key is its last touch and session, as in the batch form; touches must come in order of time.
    """

    def step(k, batches, state: GroupState):
        last, session = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        numbers = []
        for us in rows["us"]:
            session += last is None or us - last >= ttl * 1_000_000
            last = max(us, last or us)
            numbers.append(session)
        state.update((int(last), int(session)))
        yield pd.DataFrame({"key": k[0], "event_id": rows["event_id"], "session": numbers})

    keyed = events.select(F.col(key).cast("long").alias("key"), "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return keyed.groupBy("key").applyInPandasWithState(step, "key long, event_id long, session long", "last long, session long", "append", GroupStateTimeout.NoTimeout)


def dedupe_stream(rows: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
