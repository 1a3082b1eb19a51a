"""The job queue as a fold over a log of events, in batches or over a stream.

Events have queue, event_id, at, kind and, by kind, job, dedupe_key, retryable and retry_after:

* enqueue: a new job, or the one that holds its dedupe_key (active or completed)
* claim: the oldest job that is runnable then: pending, due for retry, or running and stale
* complete, fail, cancel: of ``job``, or of the job that runs longest where it is null. A retryable failure below the most
  attempts waits for what the provider asked, else longer each time; failed and cancelled jobs free their key

Each event gives one transition (queue, event_id, job, before, after, attempts, not_before); an event that its job's state
does not allow, a claim of an empty queue and an unknown job leave all as it is (after is null). Events of one queue are
taken in order of time and id. Queues are independent; one queue is one order by nature, its active jobs are what a
worker holds, finished jobs are looked up by key alone.
"""

from __future__ import annotations

import json
from collections.abc import MutableMapping
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.jobs import BACKOFF_BASE, BACKOFF_CAP, MACHINES, MAX_ATTEMPTS, REUSED, STALE
from ..session import ship
from .ordered import InOrder, ordered_stream

EVENT = "event_id long, us long, kind string, job long, dedupe_key string, retryable boolean, retry_after long"
COLUMNS = tuple(c.split()[0] for c in EVENT.split(", "))
TRANSITION = "queue long, event_id long, job long, before string, after string, attempts int, not_before long"
#: A job in state: status, created, started, not_before, attempts, dedupe_key; times in microseconds.
JOB = "status string, created long, started long, not_before long, attempts int, dedupe_key string"
SECOND = 1_000_000


class Jobs:
    """Active jobs of one queue, by id, with the orders in which claims look for them.

    ``active``, ``done`` (id to job) and ``held`` (dedupe_key to id) may be plain dicts or maps kept in a store.
    """

    def __init__(self, active: dict, done: MutableMapping, held: MutableMapping):
        self.active, self.done, self.held = active, done, held
        self.changed: set[int] = set()
        self.now = 0
        self.orders: dict[str, list] = {"ready": [], "waiting": [], "running": []}
        for name in active:
            self._enter(name)
        for heap in self.orders.values():
            heapify(heap)

    def _enter(self, name: int, push=list.append) -> None:
        status, created, started, not_before, *_ = self.active[name]
        if status == "running":
            push(self.orders["running"], (started, created, name))
        elif not_before is not None:
            push(self.orders["waiting"], (not_before, created, name))
        else:
            push(self.orders["ready"], (created, name))

    def _is(self, order: str, entry: tuple) -> bool:
        """Whether an entry of an order still tells its job's state."""
        job = self.active.get(entry[-1])
        if job is None or (job[0] == "running") != (order == "running"):
            return False
        if order == "ready":
            return entry[0] == job[1] and (job[3] is None or job[3] <= self.now)
        return entry[0] == (job[2] if order == "running" else job[3])

    def _first(self, order: str) -> tuple | None:
        heap = self.orders[order]
        while heap and not self._is(order, heap[0]):
            heappop(heap)
        return heap[0] if heap else None

    def _put(self, name: int, job: tuple) -> None:
        self.active[name] = job
        self.changed.add(name)
        self._enter(name, heappush)

    def _finish(self, name: int, job: tuple) -> None:
        del self.active[name]
        self.changed.add(name)
        self.done[name] = job

    def runnable(self, now: int) -> int | None:
        """The oldest runnable job. What has become due joins the ready ones; what is running and stale competes by age."""
        self.now = now
        while (first := self._first("waiting")) and first[0] <= now:
            heappush(self.orders["ready"], heappop(self.orders["waiting"])[1:])
        stale = []
        while (first := self._first("running")) and first[0] < now - STALE * SECOND:
            stale.append(heappop(self.orders["running"]))
        ready = self._first("ready")
        found = min([*([ready] if ready else []), *(s[1:] for s in stale)], default=None)
        for s in stale:
            heappush(self.orders["running"], s)
        return found[-1] if found else None

    def take(self, e: dict) -> tuple:
        """(job, before, after, attempts, not_before) of an event."""
        now, kind, name = e["us"], e["kind"], e["job"]
        if kind == "enqueue":
            return self._enqueue(now, name, e["dedupe_key"])
        if kind == "claim":
            name = self.runnable(now)
        elif name is None:
            first = self._first("running")
            name = first[-1] if first else None
        job = self.active.get(name) or (self.done.get(name) if name is not None else None)
        if job is None:
            return name, None, None, None, None
        status, created, started, not_before, attempts, key = job
        event = "reclaim" if kind == "claim" and status == "running" else kind
        attempts += kind == "fail" and status == "running"
        if kind == "fail" and e["retryable"] and attempts < MAX_ATTEMPTS:
            event = "retry"
        after = MACHINES["ai_job"].get((status, event))
        if after is None:
            return name, status, None, job[4], not_before
        if after == "running":
            self._put(name, (after, created, now, None, attempts, key))
            return name, status, after, attempts, None
        if after == "retry_scheduled":
            wait = e["retry_after"] if e["retry_after"] is not None else min(BACKOFF_BASE * 2 ** (attempts - 1), BACKOFF_CAP)
            not_before = now + max(wait, 1) * SECOND
            self._put(name, (after, created, started, not_before, attempts, key))
            return name, status, after, attempts, not_before
        if name in self.active:
            self._finish(name, (after, created, started, None, attempts, key))
            if after not in REUSED and key is not None and self.held.get(key) == name:
                del self.held[key]
        return name, status, after, attempts, None

    def _enqueue(self, now: int, name: int, key: str | None) -> tuple:
        other = self.held.get(key) if key is not None else None
        if other is None:
            other = name if name in self.active or self.done.get(name) else None
        if other is not None:
            job = self.active.get(other) or self.done.get(other)
            return other, job[0], None, job[4], job[3]
        self._put(name, ("pending", now, None, None, 0, key))
        if key is not None:
            self.held[key] = name
        return name, None, "pending", 0, None


def replay_batch(events: DataFrame) -> DataFrame:
    """Transitions of a whole log: events of a queue are sorted and streamed through one fold."""
    ship(events.sparkSession)
    rows = events.withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).select("queue", *COLUMNS)
    dealt = rows.repartition("queue").sortWithinPartitions("queue", "us", "event_id")
    kinds = to_arrow_schema(StructType.fromDDL(TRANSITION))

    def body(batches):
        queue, jobs = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if jobs is None or r["queue"] != queue:
                    queue, jobs = r["queue"], Jobs({}, {}, {})
                out.append((queue, r["event_id"], *jobs.take(r)))
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(columns, kinds)], names=kinds.names)

    return _timed(dealt.mapInArrow(body, TRANSITION))


def _timed(transitions: DataFrame) -> DataFrame:
    return transitions.withColumn("not_before", F.timestamp_micros("not_before"))


class _Kept(MutableMapping):
    """A map over one in the state store (None: over nothing) that looks up a key at most once and holds back what changes.

    ``now`` has the values that need no look.
    """

    def __init__(self, state, now: dict):
        self.state, self.now = state, now

    def get(self, k, default=None):
        if k not in self.now:
            value = self.state.getValue((k,)) if self.state is not None else None
            self.now[k] = value if value is None or len(value) > 1 else value[0]
        return default if self.now[k] is None else self.now[k]

    def __getitem__(self, k):
        if (v := self.get(k)) is None:
            raise KeyError(k)
        return v

    def __setitem__(self, k, v):
        self.now[k] = v

    def __delitem__(self, k):
        self.now[k] = None

    def __iter__(self):
        return (k for k, v in self.now.items() if v is not None)

    def __len__(self):
        return sum(1 for _ in self)


class _Queue(InOrder):
    """Active jobs are one value, as each batch needs them all, and hold their dedupe keys; finished ones are kept by id, and
    the keys of completed ones, which nothing frees, by key. Nothing is looked up in a queue where no job has finished."""

    def open(self, handle) -> None:
        self.active, self.done = handle.getValueState("active", "jobs string"), handle.getMapState("done", "job long", JOB)
        self.held = handle.getMapState("held", "dedupe_key string", "job long")

    def take(self, key, rows, known):
        was = self.active.get()
        active = {job[0]: tuple(job[1:]) for job in json.loads(was[0])} if was else {}
        kept = self.done.exists()
        done = _Kept(self.done if kept else None, {})
        jobs = Jobs(active, done, _Kept(self.held if kept else None, {job[-1]: name for name, job in active.items() if job[-1] is not None}))
        out = [(key[0], r["event_id"], *jobs.take(r)) for r in rows]
        for name in jobs.changed - active.keys():
            job = done[name]
            self.done.updateValue((name,), job)
            if job[0] in REUSED and job[-1] is not None:
                self.held.updateValue((job[-1],), (name,))
        if jobs.changed:
            self.active.update((json.dumps([(name, *job) for name, job in active.items()]),))
        return out, None


def queue_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``replay_batch`` over a stream: active jobs, finished ones and held keys are state in a store, by queue."""
    rows = events.select("queue", "event_id", F.col("at").cast("timestamp").alias("at"), "kind", "job", "dedupe_key", "retryable", "retry_after")
    return _timed(ordered_stream(rows, "queue", "at", late, _Queue(), TRANSITION))
