"""Exact cases of the core operators."""

import random
import re
from collections import deque

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern import registry
from lectern.functions import text as T
from lectern.functions import workers
from lectern.operators import chunking, jobs, layout, privacy, reports, retrieval
from lectern.plans import pipelines
from lectern.sources import stores
from lectern.streaming import machines


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def test_alphabetic_suffix(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 26, 27, 28, 52, 53)], "n int").select(T.alphabetic_suffix(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["A", "Z", "AA", "AB", "AZ", "BA"]


def test_even_sample(spark):
    assert one(spark, T.even_sample(F.col("n"), 3), n=1) == [1]
    assert one(spark, T.even_sample(F.col("n"), 3), n=10) == [1, 5, 10]
    assert one(spark, T.even_sample(F.col("n"), 2), n=10) == [1, 10]


def test_checks(spark):
    card, iban, ident = privacy.valid_card(F.col("s")), privacy.valid_iban(F.col("s")), privacy.identifier_class(F.col("s"))
    assert one(spark, card, s="4111 1111 1111 1111") and not one(spark, card, s="0000 0000 0000 0000")
    assert one(spark, iban, s="KZ86125KZT5004100100") and not one(spark, iban, s="KZ00125KZT5004100100")
    assert one(spark, ident, s="900101300007") == "IIN" and one(spark, ident, s="240140000001") == "BIN"
    assert one(spark, ident, s="900101300008") is None


def test_overlap_resolution_and_patterns(spark):
    docs = spark.createDataFrame([(1, "ИИН: 123456789012, сумма 5 000 ₸ и mail a.b@c.org"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["category"], s["confidence"]) for s in r["spans"]] for r in privacy.detect(docs).collect()}
    assert got[1] == [("IIN", 0.96), ("AMOUNT", 0.95), ("EMAIL", 0.98)] and got[2] == got[3] == []


def test_mask_restore(spark):
    rows = spark.createDataFrame([(1, "a@b.co, c@d.co; A@B.co"), (2, "none")], "k int, text string")
    m = privacy.mask(rows, r"[A-Za-z]+@[A-Za-z.]+", "EMAIL").orderBy("k")
    assert [r["masked"] for r in m.collect()] == ["[EMAIL_1], [EMAIL_2]; [EMAIL_1]", "none"]
    back = m.select(privacy.restore(F.col("masked"), F.col("tokens"), "EMAIL").alias("t")).collect()
    assert back[0]["t"] == "a@b.co, c@d.co; a@b.co"
    assert m.select(privacy.unknown_tokens(F.lit("[EMAIL_9] [EMAIL_1]"), F.col("tokens"), "EMAIL").alias("u")).first()["u"] == ["[EMAIL_9]"]


def test_quality_rules(spark):
    def quality(text, method="native"):
        q, r = T.page_quality(T.profile(F.col("t")), F.lit(method), F.lit("unknown"))
        return one(spark, F.struct(q.alias("q"), r.alias("r")), t=text)

    clean = "A clean sentence with more than thirty letters in it."
    assert quality(clean)["q"] == "high" and quality(clean, "ocr")["q"] == "medium"
    assert quality("мiксед wоrds аre нere, sоme mоre " + clean)["r"] == ["mixed_scripts"]
    assert quality("")["q"] == "low"


def test_chunker_and_overlap(spark):
    text = ("word " * 700).strip()
    pieces = chunking.cut(text)
    assert max(map(len, pieces)) <= 1600 and pieces[0].endswith("word")
    pages = spark.createDataFrame([(1, 1, text), (1, 2, "tail"), (2, 1, "  "), (3, 1, None)], "doc_id long, page_number int, text string")
    chunks = chunking.chunk(pages)
    assert [r["chunk_index"] for r in chunks.filter("doc_id = 1").orderBy("chunk_index").collect()] == list(range(len(pieces) + 1))
    shared = "x" * 32
    pair = spark.createDataFrame([(1, 1, 0, "a" + shared), (1, 1, 1, shared + "b")], "doc_id long, page_number int, chunk_index int, text string")
    assert [r["overlap"] for r in chunking.trim_overlaps(pair).orderBy("chunk_index").collect()] == [0, 32]


def test_rate_limiter_denied_requests_leave_no_trace():
    log = deque()
    assert [jobs.limit_step(log, t, 2) for t in (0, 0.1, 0.2, 59.9, 60.0, 60.05)] == [0, 0, 60, 1, 0, 1]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    events = spark.range(60).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("client"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = machines.rate_limit_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 2, forget=False)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted(map(tuple, rows))
    assert key(spark.table("limited").collect()) == key(jobs.rate_limit(events, 2).collect())


def test_sessions_open_at_exactly_the_ttl(spark):
    e = spark.createDataFrame([(1, 1, 0), (2, 1, 899), (3, 1, 1799)], "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["touches"] for r in jobs.sessionize(e, "user_id", "ts").orderBy("session").collect()] == [2, 1]


def test_queue(spark):
    assert [one(spark, jobs.retry_delay(F.col("n")), n=n) for n in (1, 2, 5, 9)] == [5.0, 10.0, 60.0, 60.0]
    assert one(spark, jobs.advance(F.col("s"), F.lit("claim")), s="pending") == "running"
    assert one(spark, jobs.advance(F.col("s"), F.lit("cancel")), s="completed") is None


def test_history_keeps_old_active_rows(spark):
    rows = spark.range(56).select("id", F.when(F.col("id") == 0, "pending").otherwise("done").alias("status"), F.col("id").alias("created_at"))
    assert reports.recent_or_active(rows, F.col("status") == "pending").count() == 51


def test_retrieval_of_small_and_large_documents(spark):
    chunks = spark.createDataFrame([(1, i, f"chunk number {i} " + ("needle" if i == 3 else "hay")) for i in range(6)] + [(2, 0, "short")], "doc_id long, chunk_index int, text string")
    questions = spark.createDataFrame([(1, "where is the needle")], "question_id int, question string")
    got = pipelines.ask(chunks, questions, 2)
    assert {r["method"] for r in got.filter("doc_id = 2").collect()} == {"full_document"}
    assert 3 in {r["chunk_index"] for r in got.filter("doc_id = 1").collect()}
    assert retrieval.top_chunks(retrieval.bm25(chunks, questions)).first()["chunk_index"] == 3


def test_map_reduce_ends_with_one_answer(spark):
    chunks = spark.createDataFrame([(1, i, "x" * 5000) for i in range(5)] + [(2, 0, "y")], "doc_id long, chunk_index int, text string")
    got = pipelines.map_reduce(chunks, lambda t: F.substring(t, 1, 5000))
    assert got.count() == 2


def test_word_goes_to_the_only_cell(spark):
    words = spark.createDataFrame([(1, 1, 10, 10, 10, 10), (1, 2, 60, 10, 10, 10)], "page_id long, word_id long, left int, top int, width int, height int")
    cells = spark.createDataFrame([(1, 1, 0, 0, 50, 50), (1, 2, 50, 0, 100, 50), (1, 3, 55, 0, 90, 50)], "page_id long, cell_id long, left int, top int, right int, bottom int")
    assert [(r["word_id"], r["cell_id"]) for r in layout.words_in_cells(words, cells).collect()] == [(1, 1)]


def test_failures_of_an_engine_are_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 one")
    (tmp_path / "b.pdf").write_bytes(b"nope")
    files = stores.validate_uploads(stores.read_files(spark, str(tmp_path)))
    assert sorted(str(r["reject_code"]) for r in files.collect()) == ["400", "None"]

    def engine(content):
        if not content.startswith(b"%PDF-"):
            raise ValueError("bad")
        return ["page one", "page two"]

    rows = stores.extract_pages(files, engine).collect()
    assert sorted((r["page_number"] or 0, r["error"]) for r in rows) == [(0, "ValueError: bad"), (1, None), (2, None)]

def test_every_word_of_a_long_page_gets_its_line_and_cell(spark):
    def read(name):
        return spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(2500))), (2, "a b"), (3, None)], "doc_id long, text string")

    words = registry._all_words(read)
    assert words.count() == words.select("word_id").distinct().count() == 2502
    text = {r["page_id"]: r["text"] for r in layout.assemble_lines(words).collect()}
    assert text[1].split() == [f"w{i}" for i in range(2500)] and len(text[1].split("\n")) == 250
    cells = {r["word_id"]: r["cell_id"] for r in registry.words_in_cells(spark, read).collect()}
    assert len(cells) == 2502 and cells[(1 << 31) + 2499] == 249 * 20 // 80 * 5 + 4
    low = {r["page_id"]: r["low_ratio"] for r in layout.weighted_confidence(words).collect()}
    assert low[1] == round(sum(i % 60 < 20 for i in range(2500)) / 2500, 6)


def test_pages_may_use_the_same_word_numbers(spark):
    words = spark.createDataFrame([(p, 7, 10, 10, 10, 10) for p in (1, 2)], "page_id long, word_id long, left int, top int, width int, height int")
    cells = spark.createDataFrame([(p, p, 0, 0, 50, 5000) for p in (1, 2)], "page_id long, cell_id long, left int, top int, right int, bottom int")
    assert sorted(r["cell_id"] for r in layout.words_in_cells(words, cells).collect()) == [1, 2]

def test_similarity_in_blocks_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    vectors = [(i, [float(i % 5), float(i % 3), 0.0 if i % 7 else 1.0]) for i in range(60)]
    items = spark.createDataFrame(vectors, "item long, embedding array<float>")
    questions = items.filter("item % 20 = 0").withColumnRenamed("item", "question_id")
    pairs = items.join(questions.withColumnRenamed("embedding", "q"), F.col("item") != F.col("question_id"))
    want = pairs.select("question_id", "item", F.round(retrieval.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    assert sorted(map(tuple, retrieval.similar(items, questions).collect())) == sorted(map(tuple, want.collect()))
    best = lambda df: sorted((r["question_id"], r["chunk_index"]) for r in retrieval.top_chunks(df.selectExpr("question_id", "0 AS doc_id", "item AS chunk_index", "score")).collect())
    assert best(retrieval.similar(items, questions, 5)) == best(want) and len(best(want)) == 15
    assert retrieval.similar(items, questions.limit(0), 5).count() == 0


def test_fusion_shuffles_its_pairs_once(spark):
    rows = [(q, i, round(1 - (i * 7 % 5) / 10, 6), None if i == 3 else float(i % 4 - 1)) for q in (1, 2) for i in range(12)]
    fused = retrieval.fuse(spark.createDataFrame(rows, "question_id long, item long, score double, lexical double"))
    plan = fused._jdf.queryExecution().sparkPlan().toString(), fused._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[0] and plan[1].count("Exchange") == 1
    first = sorted(rows[:12], key=lambda r: (-r[2], r[1]))
    second = sorted((r for r in rows[:12] if r[3] is not None and r[3] > 0), key=lambda r: (-r[3], r[1]))
    want = {r[1]: round(1 / (61 + first.index(r)) + (1 / (61 + second.index(r)) if r in second else 0), 9) for r in first}
    assert all({r["item"]: r["rrf"] for r in fused.filter(f"question_id = {q}").collect()} == want for q in (1, 2))


def test_fusion_of_similar_vectors_is_that_of_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    vector = lambda i: [float(rng.randint(-2, 2)), float(i % 3), 0.0] if i % 11 else [float("nan"), 0.0, 1.0] if i % 2 else [0.0] * 3
    rows = [(i * 7 % 300, vector(i), None if i % 13 == 0 else float("nan") if i % 17 == 0 else float(i % 4 - 1)) for i in range(300)]
    items = spark.createDataFrame(rows, "item long, embedding array<float>, lexical double").repartition(5)
    twice = [(q, [float(q % 2), 1.0, 0.5]) for q in (20, 20, 1000)]  # a question with two vectors, one that is no item
    questions = items.filter("item % 20 = 0 AND item <> 20").selectExpr("item AS question_id", "embedding").union(spark.createDataFrame(twice, "q long, v array<float>"))
    want = retrieval.fuse(retrieval.similar(items, questions, None, "lexical"))
    found = lambda df: (sorted(map(tuple, df.filter("question_id <> 20").collect())), df.filter("question_id = 20").groupBy("item").count().filter("count = 2").count())
    whole = retrieval.fuse_similar(items, questions)
    monkeypatch.setattr(retrieval, "HELD", 1), monkeypatch.setattr(retrieval, "PACKED", 200), monkeypatch.setattr(retrieval, "GIVEN", 7)
    parted = retrieval.fuse_similar(items, questions)
    assert len(found(want)[0]) == 14 * 299 + 300 and found(whole) == found(parted) == found(want) and whole.schema.simpleString() == want.schema.simpleString()
    assert sum(r["rrf"] for r in parted.filter("question_id = 20").collect()) == pytest.approx(sum(r["rrf"] for r in want.filter("question_id = 20").collect()))
    assert retrieval.fuse_similar(items, questions.limit(0)).count() == retrieval.fuse_similar(items.limit(0), questions).count() == 0
    with pytest.raises(Exception, match="one length"):
        retrieval.fuse_similar(items.union(spark.createDataFrame([(301, [1.0], 1.0)], items.schema).repartition(1)).coalesce(1), questions).count()


def test_pairs_of_the_fusion_are_not_shuffled(spark, sf_dir):
    plan = registry.queries()["rrf_fusion"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = re.split("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert len(above) == 2 and "Exchange" not in above[0] and "Sort" not in above[0]


def test_overlaps_equal_brute_force(spark):
    rng, rows = random.Random(1), []
    for i in range(400):
        letters, n, m = rng.choice(["a", "ab", "abcé ", "xyz"]), rng.choice([0, 19, 20, 21, 149, 150, 151, 400]), rng.choice([0, 19, 20, 30, 150, 151])
        a = "|" + "".join(rng.choice(letters) for _ in range(n))
        b = (a[len(a) - m :] if m <= len(a) else "") + "".join(rng.choice(letters) for _ in range(rng.choice([1, 19, 30, 200]))) + "|"
        rows.append((i, 1, 0, a)), rows.append((i, 1, 1, b))
    want = {i: max([k for k in range(20, 151) if k <= len(a[3]) and k <= len(b[3]) and a[3].endswith(b[3][:k])], default=0) for i, (a, b) in enumerate(zip(rows[::2], rows[1::2]))}
    found = chunking.trim_overlaps(spark.createDataFrame(rows, "doc_id long, page_number int, chunk_index int, text string"))
    assert {r["doc_id"]: r["overlap"] for r in found.filter("chunk_index = 1").collect()} == want and len(set(want.values())) > 5
    assert ", tail, " in found._jdf.queryExecution().analyzed().toString()  # only ends of texts meet


def test_workers_see_bounded_parts_of_batches(spark):
    session = spark.newSession()
    docs = session.createDataFrame([(i, "word " * 2000) for i in range(40)], "doc_id long, text string")
    assert chunking.chunk_documents(docs).count() > 40 and session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 5000})
    parts = list(workers.slices(iter([batch, batch.slice(0, 0)])))
    assert sum(p.num_rows for p in parts) == 5000 and max(p.nbytes for p in parts) <= 1.1 * workers.SLICE_BYTES and len(parts) >= 4


@pytest.mark.parametrize("name", ["review_thorough", "committed_texts", "budget_chunks", "primary_language"])
def test_queries_bound_what_reaches_a_worker(spark, sf_dir, name):
    session = spark.newSession()
    registry.queries()[name](session, sf_dir)
    sizes = lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in bs)
    told = lambda rows: session.range(0, rows, 1, 1).selectExpr("id", f"repeat('x', {40_000_000 // rows}) AS t").mapInArrow(sizes, "n long, size long").collect()
    assert max(r["n"] for r in told(4000)) <= workers.BATCH_ROWS and sum(r["n"] for r in told(4000)) == 4000
    assert max(r["size"] for r in told(40)) <= 1.5 * workers.BATCH_BYTES and sum(r["n"] for r in told(40)) == 40
