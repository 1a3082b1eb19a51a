"""Queues, sessions, limits, versioned tables and placed words against brute force, over batches and streams."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.operators import evidence, findings, jobs, layout, privacy
from lectern.sources import versions
from lectern.streaming import ordered, queue, sessions

START = datetime(2024, 1, 1)
LOG = "queue long, event_id long, at timestamp, kind string, job long, dedupe_key string, retryable boolean, retry_after long"


def _log(seed, n=300):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += rng.choice([0, 0.5, 2, 9, 40, 200])
        kind = rng.choice(["enqueue", "enqueue", "claim", "claim", "complete", "fail", "fail", "cancel"])
        job = i if kind == "enqueue" else rng.choice([None, None, rng.randrange(n)])
        rows.append((rng.choice([1, 1, 2, None]), i, START + timedelta(seconds=at), kind, job, rng.choice([None, "a", "b", "c"]), rng.random() < 0.7, rng.choice([None, None, 3, 100])))
    return rows


def _brute(rows):
    """Transitions by lists and scans, with none of the operator's orders."""
    queues, out = defaultdict(list), []
    for q, i, at, kind, name, key, retryable, after_s in sorted(rows, key=lambda r: (r[2], r[1])):
        all_jobs = queues[q]
        us = int((at - START).total_seconds() * 1_000_000)
        active = [j for j in all_jobs if j["status"] in ("pending", "running", "retry_scheduled")]
        if kind == "enqueue":
            job = next((j for j in all_jobs if key is not None and j["key"] == key and j["status"] in ("pending", "running", "retry_scheduled", "completed")), None)
            if job is None:
                all_jobs.append({"id": name, "status": "pending", "created": us, "started": None, "not_before": None, "attempts": 0, "key": key})
                out.append((q, i, name, None, "pending", 0, None))
                continue
            out.append((q, i, job["id"], job["status"], None, job["attempts"], job["not_before"]))
            continue
        if kind == "claim":
            due = [j for j in active if (j["status"] != "running" and (j["not_before"] is None or j["not_before"] <= us)) or (j["status"] == "running" and j["started"] < us - 300_000_000)]
            job = min(due, key=lambda j: (j["created"], j["id"]), default=None)
        elif name is None:
            job = min((j for j in active if j["status"] == "running"), key=lambda j: (j["started"], j["created"], j["id"]), default=None)
        else:
            job = next((j for j in all_jobs if j["id"] == name), None)
        if job is None:
            out.append((q, i, None if kind == "claim" else name, None, None, None, None))
            continue
        before, after = job["status"], None
        if kind == "claim":
            after = "running"
            job.update(started=us, not_before=None)
        elif kind == "cancel" and before in ("pending", "running", "retry_scheduled", "cancelled"):
            after = "cancelled"
        elif kind == "complete" and before == "running":
            after = "completed"
        elif kind == "fail" and before == "running":
            job["attempts"] += 1
            if retryable and job["attempts"] < 4:
                after = "retry_scheduled"
                wait = after_s if after_s is not None else min(5 * 2 ** (job["attempts"] - 1), 60)
                job["not_before"] = us + max(wait, 1) * 1_000_000
            else:
                after = "failed"
        if after:
            job["status"] = after
            if after in ("completed", "failed", "cancelled"):
                job["not_before"] = None
        out.append((q, i, job["id"], before, after, job["attempts"], job["not_before"]))
    return sorted(out, key=str)


def _told(df):
    us = (F.unix_micros("not_before") - int(START.timestamp() * 1_000_000)).alias("us")
    return sorted((tuple(r) for r in df.select("queue", "event_id", "job", "before", "after", "attempts", us).collect()), key=str)


@pytest.fixture(scope="module")
def utc(spark):
    return spark


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_queue_equals_a_scan_of_all_jobs(spark, seed):
    rows = _log(seed)
    assert _told(queue.replay_batch(spark.createDataFrame(rows, LOG))) == _brute(rows)


def _stream(session, path, run, name, **options):
    source = session.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return run(source).writeStream.format("parquet").option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start(f"{path}/out")


@pytest.fixture
def streaming(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def test_queue_stream_of_a_shuffled_log_goes_on_after_a_restart(spark, streaming, tmp_path):
    rows = [r for r in _log(4, 160) if r[0] is not None]
    shuffled = random.Random(5).sample(rows, len(rows))
    home = f"file://{tmp_path}"
    run = lambda source: queue.queue_stream(source, "1 day")
    for part in (shuffled[:50], shuffled[50:90]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(f"{home}/in")
    _stream(streaming, home, run, "checkpoint").awaitTermination()
    assert spark.read.parquet(f"{home}/out").isEmpty()  # nothing is certain before the watermark
    spark.createDataFrame(shuffled[90:], LOG).coalesce(1).write.mode("append").parquet(f"{home}/in")
    spark.createDataFrame([(9, -1, START + timedelta(days=30), "end", None, None, None, None)], LOG).coalesce(1).write.mode("append").parquet(f"{home}/in")
    _stream(streaming, home, run, "checkpoint").awaitTermination()  # another query, from the checkpoint of the first
    assert _told(spark.read.parquet(f"{home}/out")) == _brute(rows)


class _Store:
    """State in a dict, of any kind, that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*a):
            self.calls += 1
            at = a[0] if a and isinstance(a[0], tuple) and name not in ("update", "appendValue") else ()
            if name in ("updateValue", "update"):
                self.held[at] = a[-1]
            elif name == "appendValue":
                self.held.setdefault("list", []).append(a[0])
            elif name in ("clear", "removeKey"):
                self.held.clear() if name == "clear" else self.held.pop(at)
            return {"exists": bool(self.held), "get": iter(self.held["list"]) if "list" in self.held else self.held.get(()), "getValue": self.held.get(at), "containsKey": at in self.held}.get(name)

        return call


class _Handle:
    def __init__(self):
        self.stores = defaultdict(_Store)
        self.alarms = []
        self.getListState = self.getMapState = self.getValueState = lambda name, *schemas: self.stores[name]
        self.registerTimer = self.alarms.append

    def calls(self):
        return sum(s.calls for s in self.stores.values())


def _machine(machine, told):
    machine.told, handle = told, _Handle()
    machine.init(handle)
    return machine, handle


@pytest.mark.parametrize("batches", [1, 7])
def test_the_store_of_a_queue_is_called_for_finished_jobs_not_for_events(batches):
    rows = [r for r in _log(6, 400) if r[0] == 1]
    us = lambda r: int((r[2] - START).total_seconds() * 1_000_000)
    events = [dict(zip(queue.COLUMNS, (r[1], us(r), *r[3:]))) for r in rows]
    machine, handle = _machine(queue._Queue(), ())
    got = []
    for i in range(batches):  # the state is read again in each
        got += machine.take((1,), events[i * len(events) // batches : (i + 1) * len(events) // batches], 0)[0]
    assert sorted(got, key=str) == _brute(rows)
    finished = sum(1 for g in got if g[4] in ("completed", "failed", "cancelled"))
    if batches == 1:
        assert handle.calls() <= 2 * finished + 3 and handle.calls() < len(rows)


def test_rows_of_a_batch_wait_as_one_value():
    machine, handle = _machine(sessions._Sessions(900), ("key", "first", "last", "touches"))
    row = lambda us, i: Row(us=us, row=f'{{"us":{us},"event_id":{i}}}')
    list(machine.handleInputRows((1,), iter([row(5_000 - i, i) for i in range(100)]), None))
    assert handle.calls() == 1 and handle.alarms == [5]
    list(machine.handleInputRows((1,), iter([row(9_000_000_000, 100)]), None))
    known = SimpleNamespace(getCurrentWatermarkInMs=lambda: 2_000_000)
    assert [tuple(r) for r in machine.handleExpiredTimer((1,), known, None)] == [(1, 4_901, 5_000, 100)]
    assert [tuple(r) for r in machine.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10_000_000), None)] == [(1, 9_000_000_000, 9_000_000_000, 1)]


def test_sessions_expire_and_their_state_goes(spark, streaming, tmp_path):
    home = f"file://{tmp_path}"
    at = lambda s: START + timedelta(seconds=s)
    touches = [(1, 0, at(0)), (1, 1, at(100)), (1, 2, at(1000)), (2, 3, at(50)), (2, 4, at(950)), (2, 5, at(1849)), (3, 6, at(20))]
    spark.createDataFrame(touches, "user long, event_id long, ts timestamp").coalesce(1).write.parquet(f"{home}/in")
    spark.createDataFrame([(-1, -1, at(90_000))], "user long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{home}/in")
    source = streaming.readStream.schema("user long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    ended = sessions.expiring_sessions(source, "user", "ts", 900, "1 minute")
    kept = {}
    docs = [spark.createDataFrame([(10, 1, None), (11, 2, "ann"), (12, 77, None)], "doc_id long, session_id long, owner string")]
    sweep = sessions.sweep_with(lambda: docs[-1], lambda left: docs.append(spark.createDataFrame(left.collect(), left.schema)))

    def batch(df, n):
        kept[n] = [tuple(r) for r in df.collect()]
        sweep(df, n)

    query = ended.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(r for rows in kept.values() for r in rows)
    assert got == [(1, at(0), at(100), 2), (1, at(1000), at(1000), 1), (2, at(50), at(50), 1), (2, at(950), at(1849), 2), (3, at(20), at(20), 1)]
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert sizes[-1] < max(sizes)  # only the last row's session is left
    assert sorted(tuple(r) for r in docs[-1].select("doc_id", "session_id", "owner").collect()) == [(11, None, "ann"), (12, 77, None)]


@pytest.mark.parametrize("drop_late", [False, True])
def test_sessions_of_a_shuffled_stream_with_a_restart_equal_a_scan(spark, streaming, tmp_path, drop_late):
    rng = random.Random(11)
    touches, at = [], {}
    for i in range(300):
        k = rng.choice([1, 1, 2, 3])
        at[k] = at.get(k, START) + timedelta(microseconds=rng.choice([0, 1_000_000, 899_999_999, 900_000_000, 900_000_001, 5_000_000_000]))
        touches.append((k, i, at[k]))
    want = defaultdict(list)
    for k, _, t in touches:
        if want[k] and t - want[k][-1][1] < timedelta(seconds=900):
            want[k][-1][1:] = [t, want[k][-1][2] + 1]
        else:
            want[k].append([t, t, 1])
    rng.shuffle(touches)
    home, kinds = f"file://{tmp_path}", "user long, event_id long, ts timestamp"
    run = lambda: sessions.expiring_sessions(streaming.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{home}/in"), "user", "ts", 900, "60 days", drop_late)
    for part in (touches[:120], touches[120:], [(-1, -1, START + timedelta(days=200))]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(f"{home}/in")
        query = run().writeStream.format("parquet").option("checkpointLocation", f"{home}/c").trigger(availableNow=True).start(f"{home}/out")
        query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{home}/out").collect()]
    assert sorted(got) == sorted((k, *s) for k, each in want.items() for s in each)
    if not drop_late:  # no Python sees a row: only the session windows of Spark have state
        state = [o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]]
        assert state and set(state) == {"sessionWindowStateStoreSaveExec"}


@pytest.mark.parametrize("providers", [[1], [1, 2, None]])
def test_spacing_with_one_provider_for_all_rows(spark, providers):
    rng = random.Random(6)
    rows = [(i, rng.choice(providers), START + timedelta(seconds=rng.randrange(3000))) for i in range(400)]
    free, want = {}, {}
    for i, p, at in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = max(at, free.get(p, at))
        free[p] = want[i] + timedelta(seconds=12)
    df = spark.createDataFrame(rows, "id long, provider long, asked_at timestamp").repartition(5)
    got = jobs.space_requests(df, 12)
    assert {r["id"]: r["starts_at"] for r in got.collect()} == want


def test_limits_are_by_client_and_bucket_and_hold_without_a_client(spark):
    rows = [(i, None, "x", START + timedelta(seconds=i)) for i in range(5)] + [(10 + i, 7, b, START + timedelta(seconds=i)) for i, b in enumerate("xyxyx")]
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in jobs.rate_limit(spark.createDataFrame(rows, "event_id long, client long, bucket string, ts timestamp"), 2).collect()}
    assert [got[i][0] for i in range(5)] == [True, True, False, False, False]
    assert got[2][1] == 58 and [got[i][0] for i in range(10, 15)] == [True, True, True, True, False]


def _fold(rows):
    prio = {c: p for c, (_, p) in privacy.TAXONOMY.items()}
    kept = []
    for r in sorted(rows, key=lambda r: (-prio[r[3]], -r[4], r[6], r[5], r[1], r[7], r[8])):
        area = lambda a: max(a[2] - a[0], 0) * max(a[3] - a[1], 0)
        box = (r[5], r[6], r[7], r[8])
        if not any(k[0] == r[0] and k[2] == r[2] and area((max(box[0], k[5]), max(box[1], k[6]), min(box[2], k[7]), min(box[3], k[8]))) / max(min(area(box), area(k[5:9])), 1.0) > 0.75 for k in kept):
            kept.append(r)
    return kept


BOXES = "doc_id long, id string, page int, category string, confidence double, x0 double, y0 double, x1 double, y1 double, extra string"


def test_same_boxes_equal_a_fold_over_pages_where_ids_repeat(spark):
    rng = random.Random(7)
    rows = []
    for i in range(500):
        x, y, w, h = rng.uniform(-50, 300), rng.uniform(-50, 300), rng.choice([0, 3, 40, 200, 1000]), rng.choice([2, 30, 150])
        rows.append((rng.randrange(2), f"f{rng.randrange(30)}", rng.randrange(3), rng.choice(["EMAIL", "PERSON", "IIN"]), rng.choice([0.5, 0.9]), x, y, x + w, y + h, f"r{i}"))
    rows += [(1, "same", 0, "EMAIL", 0.9, 0.0, 0.0, 10.0, 10.0, "a"), (1, "same", 0, "EMAIL", 0.9, 1.0, 1.0, 9.0, 9.0, "b")]
    got = findings.drop_same_boxes(spark.createDataFrame(rows, BOXES).repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == sorted(_fold(rows))
    none = spark.createDataFrame([(1, "n", 0, "EMAIL", 0.9, None, 0.0, 1.0, 1.0, "")] * 2, BOXES)
    assert findings.drop_same_boxes(none).count() == 2


def test_a_page_of_many_boxes_passes(spark):
    n = 30_000
    boxes = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("id"), F.lit(1).alias("page"), F.lit("EMAIL").alias("category"), F.lit(0.9).alias("confidence"), (F.col("id") % 200 * 10).cast("double").alias("x0"), (F.floor(F.col("id") / 200) * 10).cast("double").alias("y0"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 10, "y1": F.col("y0") + 10, "extra": F.lit("")})
    assert findings.drop_same_boxes(boxes.unionByName(boxes.withColumn("confidence", F.lit(0.8)))).count() == n


def test_residual_text_reads_each_document_once(spark):
    docs = spark.createDataFrame([(1, "He Said\tSTRASSE nine"), (2, "abc abc"), (3, None), (4, "")], "doc_id long, text string")
    found = spark.createDataFrame([(1, "said str"), (1, "said str"), (1, "nine ten"), (2, "AB c"), (2, "ab"), (2, None), (3, "abc"), (4, "abc"), (9, "abc"), (None, "abc")], "doc_id long, text string")
    assert sorted(tuple(r) for r in evidence.residual_text(found, docs).collect()) == [(1, "said str"), (1, "said str"), (2, "AB c")]


def test_offsets_and_spans_equal_brute_force(spark):
    rng = random.Random(8)
    words = [(d, p, i, i // 9, i // 4, rng.choice(["a", "word", "ünï", "", None, "x" * 40])) for d in (1, 2) for p in (1, 2) for i in range(rng.randrange(30, 400))]
    placed = layout.word_offsets(spark.createDataFrame(words, "doc_id long, page int, place int, block int, line int, text string").repartition(4))
    rows = placed.collect()
    text = {(r["doc_id"], r["page"]): r["text"] for r in layout.page_texts(placed).collect()}
    assert all(text[r["doc_id"], r["page"]][r["start"] : r["end"]] == (r["text"] or "") for r in rows) and len(rows) == len(words)
    breaks = {t.count("\n") for t in text.values()}
    assert max(breaks) > 5
    spans = [(d, p, s, s + rng.choice([0, 1, 5, 80, 2500])) for d in (1, 2) for p in (1, 2) for s in rng.sample(range(1500), 25)]
    got = layout.span_words(spark.createDataFrame(spans, "doc_id long, page int, start long, end long"), placed)
    want = [(*s, r["place"]) for s in spans for r in rows if (r["doc_id"], r["page"]) == s[:2] and s[2] < s[3] and r["start"] < r["end"] and r["start"] < s[3] and r["end"] > s[2]]
    assert sorted(tuple(r) for r in got.select("doc_id", "page", "start", "end", "place").collect()) == sorted(want)


def test_ocr_words_come_in_points(spark):
    w = spark.createDataFrame([(150.0, 300.0, 450.0, 600.0, 12.0)], "x0 double, y0 double, x1 double, y1 double, confidence double")
    assert tuple(layout.scaled_words(w, F.lit(300)).first()) == (36.0, 72.0, 108.0, 144.0, 12.0)


def test_other_groups_hide_nothing():
    text = "ТОО Директор Иванов И. И."
    for group in privacy.TEXT_GROUPS:
        alone = privacy.detect_text(text, groups=[group])[0]
        assert all(s["group"] == group for s in alone)
    every = {s["category"] for g in privacy.TEXT_GROUPS for s in privacy.detect_text(text, groups=[g])[0]}
    assert {"PERSON", "ORG"} <= every


@pytest.fixture
def store(spark, tmp_path):
    s = versions.Store(spark, f"file://{tmp_path}/store", {"documents": "doc_id", "chunks": "doc_id", "jobs": "dedupe_key"}, buckets=4)
    docs = spark.createDataFrame([(i, f"old {i}", f"sum {i}") for i in range(20)], "doc_id long, text string, ai_summary string")
    s.create(documents=docs, chunks=_cut(docs), jobs=spark.createDataFrame([("k1", 1)], "dedupe_key string, id long"))
    return s


def _cut(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("chunk_index", "text"))


def test_a_commit_is_whole_and_snapshots_stay(spark, store):
    before = store.snapshot()
    versions.replace_texts(store, spark.createDataFrame([(3, "new text here"), (99, "nobody")], "doc_id long, text string"), _cut)
    docs = {r["doc_id"]: tuple(r)[1:] for r in store.read("documents").collect()}
    assert docs[3] == ("new text here", None) and docs[4] == ("old 4", "sum 4") and len(docs) == 20
    assert [r["text"] for r in store.read("chunks").filter("doc_id = 3").orderBy("chunk_index").collect()] == ["new", "text", "here"]
    assert store.read("chunks").count() == 41
    assert store.read("documents", before).filter("doc_id = 3").first()["text"] == "old 3" and store.read("chunks", before).count() == 40
    same = set(before["tables"]["documents"].values()) & set(store.snapshot()["tables"]["documents"].values())
    assert len(same) == 3  # only the bucket of document 3 was written again


def test_two_writers_race_and_one_starts_again(spark, store):
    entered = []

    def slow(tables, base):
        entered.append(base["version"])
        if len(entered) == 1:  # another writer commits between this one's snapshot and its commit
            versions.delete_keys(store, spark.createDataFrame([(5,)], "doc_id long"), "doc_id", "documents", "chunks")
        return {"documents": tables["documents"].withColumn("ai_summary", F.lit("done"))}

    every = store.read("documents")
    store.change(slow, documents=every)
    assert entered == [1, 2] and store.versions() == [1, 2, 3]
    now = store.read("documents")
    assert now.count() == 19 and now.filter("ai_summary = 'done'").count() == 19 and store.read("chunks").filter("doc_id = 5").isEmpty()
    with pytest.raises(versions.Conflict):
        store._commit(store.snapshot(1), {}, {})


def test_the_loser_of_a_key_reads_the_winner(spark, store):
    asked = spark.createDataFrame([("k1", 50), ("k2", 60), ("k2", 61), (None, 70)], "dedupe_key string, id long")
    assert sorted(tuple(r) for r in versions.insert_unique(store, "jobs", asked, "id").collect()) == [("k1", 1), ("k2", 60)]
    again = versions.insert_unique(store, "jobs", spark.createDataFrame([("k2", 80)], "dedupe_key string, id long"), "id")
    assert [tuple(r) for r in again.collect()] == [("k2", 60)]
    assert Counter(r["dedupe_key"] for r in store.read("jobs").collect()) == {"k1": 1, "k2": 1, None: 1}


def test_old_files_go_after_their_time(spark, store):
    for i in range(3):
        versions.replace_texts(store, spark.createDataFrame([(3, f"text {i}")], "doc_id long, text string"), _cut)
    assert store.vacuum(keep=1) == []  # too young
    gone = store.vacuum(keep=1, older_than=-1.0)
    assert gone and store.versions() == [4]
    assert store.read("documents").count() == 20 and store.read("documents").filter("doc_id = 3").first()["text"] == "text 2"


def test_a_stopped_worker_is_seen_as_gone(spark, tmp_path):
    import time

    from lectern.streaming import worker

    home, done = f"file://{tmp_path}", {"analysis": [], "tools": []}
    listener = worker.Heartbeat(spark, f"{home}/beats")
    spark.streams.addListener(listener)
    try:
        for name in done:
            spark.createDataFrame([(name, i) for i in range(3)], "queue string, job long").coalesce(1).write.parquet(f"{home}/{name}")
        sources = {n: spark.readStream.schema("queue string, job long").parquet(f"{home}/{n}") for n in done}

        def taking(name):
            return lambda df, n: done[name].extend(r["job"] for r in df.collect())

        queries = worker.work_queues(sources, {n: taking(n) for n in done}, f"{home}/checkpoint", 0.2)
        for q in queries:
            q.processAllAvailable()
        until = time.time() + 30
        while time.time() < until and (not (tmp_path / "beats").exists() or {r["name"] for r in worker.beats(spark, f"{home}/beats").filter("batch >= 0").collect()} != set(done)):
            time.sleep(0.5)
        assert {r["name"]: r["alive"] for r in worker.beats(spark, f"{home}/beats").collect()} == {"analysis": True, "tools": True}
        queries[0].stop()
        last = {r["name"]: r["at"] for r in worker.beats(spark, f"{home}/beats").collect()}
        later = {r["name"]: r["alive"] for r in worker.beats(spark, f"{home}/beats", now=last["analysis"] + 61).collect()}
        assert later["analysis"] is False and done == {"analysis": [0, 1, 2], "tools": [0, 1, 2]}
        queries[1].stop()
    finally:
        spark.streams.removeListener(listener)


def test_patterns_are_tried_where_a_match_can_begin_and_find_what_a_scan_finds():
    from lectern.registry_state import PLANTED

    rng = random.Random(3)
    bits = [line for line, *_ in PLANTED] + ["a@b.c+d@e.fg", "x.+y@m-n.kz", "ııN:900101300007", "БИНBIN 240140000001", "+7", "8", "1.02.20245", "электронный адрес: ул. Абая 5", "Төраға А.Б.", "\u1c80", "\u212az", "٣", "@", "«"]
    texts = ["".join(rng.choice([str, str.upper, str.lower])(rng.choice(bits)) + rng.choice(["", " ", "\n", "я", "1"]) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    found = 0
    for category, _, _, pattern in privacy._compiled():
        kind = privacy._kind(category, pattern)
        for t in texts:
            spans = [m.span() for m in privacy.matches(pattern, privacy._places(kind, t), t)]
            assert spans == [m.span() for m in pattern.finditer(t)], (category, t)
            found += len(spans)
        assert len(privacy._places(kind, "the words of a text without signs " * 50 + "ИИН: 1")) <= 2
    assert found > 2000


def test_detection_keeps_columns_beside_its_spans(spark):
    docs = spark.createDataFrame([(1, "ivan@mail.kz", 7), (1, "01.02.2024", 8)], "doc_id long, text string, own int")  # one id twice: a join would mix the rows
    got = privacy.detect(docs, kept=["own"]).select("own", F.inline("spans")).select("own", "category").collect()
    assert sorted(map(tuple, got)) == [(7, "EMAIL"), (8, "DATE")]
