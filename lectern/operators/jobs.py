"""Queue, session and rate-limit state machines in batch form."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..functions.ordering import in_order, join_spans, spans_of
from ..session import ship

# Attempts, backoff, stale time and spacing of the job queue, in seconds; session and limiter windows.
MAX_ATTEMPTS, BACKOFF_BASE, BACKOFF_CAP, STALE, SPACING = 4, 5, 60, 300, 12
SESSION_TTL, LIMIT_WINDOW = 900, 60
ACTIVE, REUSED = ("pending", "running", "retry_scheduled"), ("pending", "running", "retry_scheduled", "completed")
RETAINED, REMOTE_PROVIDERS = "retain_48h", ("gemini", "hybrid")
#: Every machine as (state, event) to state. An event that a state does not list is not allowed in it.
MACHINES = {
    "analysis_job": {
        ("pending", "claim"): "running", ("running", "complete"): "completed", ("running", "fail"): "failed",
        ("completed", "enqueue"): "pending", ("failed", "enqueue"): "pending",
    },
    "document": {("uploaded", "start"): "analyzing", ("analyzing", "complete"): "processed", ("analyzing", "fail"): "failed", ("processed", "start"): "analyzing", ("failed", "start"): "analyzing"},
    "tool_job": {
        ("pending", "claim"): "running", ("running", "complete"): "completed", ("running", "fail"): "failed",
        ("running", "preview"): "review", ("review", "apply"): "pending",
    },
    "ai_job": {
        ("pending", "claim"): "running", ("retry_scheduled", "claim"): "running", ("running", "reclaim"): "running",
        ("running", "complete"): "completed", ("running", "fail"): "failed", ("running", "retry"): "retry_scheduled",
        ("pending", "cancel"): "cancelled", ("running", "cancel"): "cancelled", ("retry_scheduled", "cancel"): "cancelled", ("cancelled", "cancel"): "cancelled",
    },
    "dedupe_key": {("held", "fail"): "free", ("held", "cancel"): "free", ("held", "complete"): "held", ("free", "enqueue"): "held"},
    "artifact": {("verifying", "pass"): "ready_for_ai", ("verifying", "risk"): "needs_review", ("verifying", "error"): "failed", ("ready_for_ai", "risk"): "needs_review", ("ready_for_ai", "integrity"): "failed"},
}
TRANSITIONS = MACHINES["ai_job"]


def runnable(now: Column) -> Column:
    """Pending, due for retry, or running and stale."""
    due = F.col("not_before").isNull() | (F.col("not_before") <= now)
    return (F.col("status").isin("pending", "retry_scheduled") & due) | ((F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {STALE} seconds")))


def claim_next(jobs: DataFrame, now: Column, queue: str | None = "queue") -> DataFrame:
    """The oldest runnable job of each queue (of all, if None), as the claim leaves it.

    It runs from now on; a stale one is ``restarting``. Waiting time and errors are cleared, progress is 1 at least.
    Attempts count when the provider is asked, not here.
    """
    if queue is None:
        first = jobs.filter(runnable(now)).orderBy("created_at", "id").limit(1)
    else:
        w = Window.partitionBy(queue).orderBy("created_at", "id")
        first = jobs.filter(runnable(now)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    left = {"stage": F.when(F.col("status") == "running", "restarting").otherwise("starting"), "worker_active": F.lit(True), "started_at": now, "not_before": F.lit(None).cast("timestamp")}
    if "progress" in jobs.columns:
        left["progress"] = F.greatest("progress", F.lit(1))
    left |= {c: F.lit(None).cast("string") for c in ("public_error", "private_error", "error_code") if c in jobs.columns}
    return first.withColumns(left).withColumn("status", F.lit("running"))


def provider_failed(jobs: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs whose provider call failed: retryable ones below ``most`` attempts wait, the others fail and free their key.

    Columns: attempts (this one counted), retryable, retry_after, dedupe_key.
    """
    again = F.col("retryable") & (F.col("attempts") < most)
    wait = retry_delay(F.col("attempts"), F.col("retry_after").cast("double"))
    return jobs.withColumns({
        "status": F.when(again, "retry_scheduled").otherwise("failed"), "stage": F.when(again, "retry_wait").otherwise("failed"),
        "worker_active": F.lit(False), "not_before": F.when(again, F.timestamp_micros(F.unix_micros(now) + (wait * 1_000_000).cast("long"))),
        "dedupe_key": F.when(again, F.col("dedupe_key")),
    })


def cancel(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs after a cancel, with ``allowed`` (finished ones keep their state) and ``delete_remote``: their copy at the
    provider serves no other active job."""
    allowed = ~F.col("status").isin("completed", "failed")
    busy = remote_in_use(jobs).select("provider", "remote_name", F.col("users").alias("_users"))
    out = jobs.join(busy, ["provider", "remote_name"], "left")
    others = F.coalesce("_users", F.lit(0)) - F.when(_in_use() & allowed, 1).otherwise(0)
    fresh = allowed & (F.col("status") != "cancelled")
    return out.withColumn("allowed", allowed).withColumn("delete_remote", allowed & F.col("remote_name").isNotNull() & (others <= 0)).withColumns({
        "status": F.when(allowed, "cancelled").otherwise(F.col("status")), "finished_at": F.when(fresh, now).otherwise(F.col("finished_at")),
        "dedupe_key": F.when(~allowed, F.col("dedupe_key")), "not_before": F.when(~allowed, F.col("not_before")),
    }).drop("_users")


def _in_use() -> Column:
    return F.coalesce("worker_active", F.lit(False)) | F.col("status").isin(*ACTIVE)


def remote_in_use(jobs: DataFrame) -> DataFrame:
    """(provider, remote_name, users): copies at a provider and the number of active jobs that use them."""
    named = jobs.filter(F.col("remote_name").isNotNull())
    return named.groupBy("provider", "remote_name").agg(F.count_if(_in_use()).alias("users")).filter("users > 0")


def expire_remote(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs without references to copies whose time is up; a copy that one job knows to be expired is so for all."""
    gone = jobs.filter(F.col("remote_name").isNotNull() & (F.col("remote_expires_at") <= now)).select("provider", "remote_name").distinct().withColumn("_gone", F.lit(True))
    out = jobs.join(gone, ["provider", "remote_name"], "left")
    return out.withColumn("remote_name", F.when(F.col("_gone").isNull(), F.col("remote_name"))).withColumn("remote_expires_at", F.when(F.col("_gone").isNull(), F.col("remote_expires_at"))).drop("_gone")


def release_stale_cancelled(jobs: DataFrame, now: Column, stale: int = STALE) -> DataFrame:
    """Cancelled jobs whose worker has been silent too long lose the worker flag."""
    left = (F.col("status") == "cancelled") & F.coalesce("worker_active", F.lit(False)) & (F.col("started_at") < now - F.expr(f"interval {stale} seconds"))
    return jobs.withColumn("worker_active", F.when(F.coalesce(left, F.lit(False)), F.lit(False)).otherwise(F.col("worker_active")))


def reserve_request(jobs: DataFrame, requests: DataFrame, now: Column, spacing: int = SPACING) -> DataFrame:
    """Jobs about to ask a provider: they go on if the last request of any is ``spacing`` seconds old, else wait for that.

    ``requests`` has provider and requested_at; only providers with a quota count.
    """
    last = requests.filter(F.col("provider").isin(*REMOTE_PROVIDERS)).agg(F.max("requested_at").alias("_last"))
    free = F.col("_last") + F.expr(f"interval {spacing} seconds")
    wait = F.coalesce(free > now, F.lit(False))
    out = jobs.crossJoin(F.broadcast(last))  # one row
    return out.withColumn("granted", ~wait).withColumn("not_before", F.when(wait, free)).withColumn("status", F.when(wait, "retry_scheduled").otherwise(F.col("status"))).drop("_last")


def space_requests(requests: DataFrame, spacing: int = SPACING) -> DataFrame:
    """(id, provider, asked_at, starts_at): requests of a provider in order, each ``spacing`` seconds after the one before at least.

    ``starts_at`` is the largest of asked_at(j) + (i - j) * spacing over j up to i. Each partition of a range sort takes its
    own running maximum; the number of rows and the maximum that a provider brings from earlier partitions are added to it,
    so all requests may be one provider's. Requests without a provider are one provider's.
    """
    rows = in_order(requests.select("id", "provider", "asked_at", F.unix_micros(F.col("asked_at").cast("timestamp")).alias("_us")), "provider", "_us", "id")
    gap = spacing * 1_000_000
    base = F.col("_us") - F.col("_at").bitwiseAND((1 << 33) - 1) * gap  # of the place within the partition
    spans = spans_of(rows.withColumn("_base", base), "provider", _most=F.max("_base"))
    # Places count from the provider's first row: shift by the rows before the span and by its first place.
    shift = (F.col("_first").bitwiseAND((1 << 33) - 1) - F.col("_before")) * gap
    earlier = Window.partitionBy("provider").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_shift", shift).withColumn("_carried", F.max(F.col("_most") + F.col("_shift")).over(earlier))
    both = join_spans(rows.withColumn("_base", base), spans, "provider")
    within = F.max("_base").over(Window.partitionBy("_part", "provider").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("_at") - F.col("_first") + F.col("_before")
    starts = F.greatest(within + F.col("_shift"), F.col("_carried")) + place * gap
    return both.withColumn("starts_at", F.timestamp_micros(starts)).select("id", "provider", "asked_at", "starts_at")


def upsert_jobs(jobs: DataFrame, requested: DataFrame, key: str, now: Column) -> DataFrame:
    """Jobs after enqueue requests: active ones of a key stay as they are, finished ones start anew, missing ones are added."""
    asked = requested.select(key).distinct().withColumn("_asked", F.lit(True))
    both = jobs.join(asked, key, "full")
    anew = F.col("_asked") & ~F.coalesce(F.col("status").isin("pending", "running"), F.lit(False))
    reset = {"status": F.lit("pending"), "created_at": now, "started_at": F.lit(None).cast("timestamp"), "attempts": F.lit(0)}
    return both.select(*[F.when(anew, reset[c]).otherwise(F.col(c)).alias(c) if c in reset else F.col(c) for c in jobs.columns])


def enqueue(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """(request, id): the newest job that the request's dedupe_key already has in a state that is reused, else null."""
    held = jobs.filter(F.col("status").isin(*REUSED)).groupBy("dedupe_key").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    return requested.join(held, "dedupe_key", "left").select("request", "id")


def delete_for_artifacts(jobs: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs left, artifacts refused): the jobs of the artifacts go, but where one is active or its copy at a provider serves an active job."""
    mine = jobs.join(artifacts.select("artifact_id").distinct(), "artifact_id", "left_semi")
    busy = remote_in_use(jobs).select("provider", "remote_name").withColumn("_busy", F.lit(True))
    told = mine.join(busy, ["provider", "remote_name"], "left").groupBy("artifact_id").agg(F.bool_or(_in_use() | F.coalesce("_busy", F.lit(False))).alias("refused"))
    free = told.filter("not refused").select("artifact_id")
    return jobs.join(free, "artifact_id", "left_anti"), told.filter("refused").select("artifact_id")


def reusable_remote(jobs: DataFrame, now: Column) -> DataFrame:
    """(id, other_id): for each retained job the newest other one with a live copy of the same owner, digest and provider."""
    kept = jobs.filter(F.col("retention") == RETAINED)
    live = kept.filter(F.col("remote_name").isNotNull() & (F.col("remote_expires_at").isNull() | (F.col("remote_expires_at") > now)))
    # The newest two of each group are enough: one of them is another than the job itself.
    w = Window.partitionBy("owner", "sha", "provider").orderBy(F.desc("created_at"), F.desc("id"))
    best = live.withColumn("_n", F.row_number().over(w)).filter("_n <= 2").groupBy("owner", "sha", "provider").agg(F.array_sort(F.collect_list(F.struct("_n", "id"))).alias("_best"))
    others = F.filter("_best", lambda b: b["id"] != F.col("id"))
    return kept.join(best, ["owner", "sha", "provider"], "left").select("id", F.get(others, 0)["id"].alias("other_id"))


def activity(jobs: DataFrame, key: str) -> DataFrame:
    """Per key: whether any job is active and whether any copy is left at a provider."""
    return jobs.groupBy(key).agg(F.bool_or(_in_use()).alias("any_active"), F.bool_or(F.col("remote_name").isNotNull()).alias("any_remote"))


def scaled_progress(done: Column, total: Column, low: int, high: int) -> Column:
    """Progress of a stage between ``low`` and ``high`` percent, clamped."""
    share = F.least(F.greatest(done / F.greatest(total, F.lit(1)), F.lit(0.0)), F.lit(1.0))
    return (low + F.floor(share * (high - low))).cast("int")


def dedupe_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The earliest row of each non-null key; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    first = rows.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.unionByName(rows.filter(F.col(key).isNull()))


def retry_delay(attempt: Column, retry_after: Column | None = None) -> Column:
    """Seconds to wait: what the provider asked for, else 5, 10, 20 ... up to 60; at least 1."""
    grown = F.least(F.lit(BACKOFF_BASE) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(BACKOFF_CAP)))
    return F.greatest(grown if retry_after is None else F.coalesce(retry_after, grown), F.lit(1.0))


def canonical_json(**parts: Column) -> Column:
    """One object with its keys in order, no white space, nulls kept and everything beyond ASCII escaped as UTF-16 units."""
    text = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(c: Column) -> Column:
        point = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        pair = F.concat(unit(F.floor((point - 0x10000) / 1024) + 0xD800), unit((point - 0x10000) % 1024 + 0xDC00))
        return F.when(point < 128, c).when(point < 0x10000, unit(point)).otherwise(pair)

    characters = F.regexp_extract_all(text, F.lit("(?s)."), 0)
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(characters, escaped), "")).otherwise(text)


def dedupe_key(**parts: Column) -> Column:
    """sha256 of the parts as canonical JSON."""
    return F.sha2(canonical_json(**parts), 256)


def advance(state: Column, event: Column, machine: str = "ai_job") -> Column:
    """Next state of a machine; null where the event is not allowed."""
    table = F.create_map(*[F.lit(x) for (st, ev), to in MACHINES[machine].items() for x in (f"{st} {ev}", to)])
    return F.element_at(table, F.concat_ws(" ", state, event))


def sessionize(events: DataFrame, key: str, ts: str, ttl: int = SESSION_TTL) -> DataFrame:
    """(key, session, first, last, touches): a touch ``ttl`` seconds or more after the one before opens a new session."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    marked = events.withColumn("_new", (gap.isNull() | (gap >= ttl * 1_000_000)).cast("int"))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("touches"))


def limit_step(times: deque, now: float, limit: int, window: float = LIMIT_WINDOW, second: float = 1) -> int:
    """One request against the log of allowed ones: 0 if allowed (and logged), else whole seconds to wait. ``second`` is the
    unit of the times; with integers, such as microseconds, all is exact."""
    while times and now - times[0] >= window:
        times.popleft()
    if len(times) >= limit:
        return max(1, int(-(-(window - (now - times[0])) // second)))
    times.append(now)
    return 0


def rate_limit(requests: DataFrame, limit: int, window: int = LIMIT_WINDOW) -> DataFrame:
    """(event_id, client, bucket, allowed, retry_after): denied requests leave no trace in the window, so the log is a fold.

    A client has a log for each bucket (one where ``requests`` has no such column); requests without a client share one, as
    do those without a bucket. Rows of a log are sorted and streamed through in batches; a worker holds one log of at most
    ``limit`` times. ``client`` and ``bucket`` keep their types.
    """
    ship(requests.sparkSession)
    if "bucket" not in requests.columns:
        requests = requests.withColumn("bucket", F.lit(None).cast("string"))
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    dealt = requests.select("event_id", "client", "bucket", us).repartition("client", "bucket").sortWithinPartitions("client", "bucket", "us", "event_id")
    out = StructType([*dealt.schema.fields[:3], StructField("allowed", BooleanType()), StructField("retry_after", IntegerType())])

    def body(batches):
        now, log = None, deque()
        for b in batches:
            waits = []
            for client, bucket, us in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                if (client, bucket) != now:
                    now, log = (client, bucket), deque()
                waits.append(limit_step(log, us, limit, window * 1_000_000, 1_000_000))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([w == 0 for w in waits], pa.bool_()), pa.array(waits, pa.int32())], names=out.names)

    return dealt.mapInArrow(body, out)
