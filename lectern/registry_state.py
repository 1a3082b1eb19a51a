"""Queries of streams, versioned tables and placed words over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import answers
from .operators import chunking, findings, layout, privacy
from .registry import _CHUNKS, query
from .session import materialise, scratch_folder
from .sources import registration, versions
from .streaming import ordered, queue, sessions

#: The log of the queue queries: times of ``events`` 2000 times as dense, a queue for each user.
_LOG = """g AS (
    SELECT user_id AS queue, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 2000 AS us, event_id,
           ['enqueue', 'enqueue', 'claim', 'enqueue', 'claim', 'complete', 'fail', 'cancel'][event_id % 8 + 1] AS kind, CASE WHEN event_id % 8 IN (0, 1, 3) THEN event_id END AS job,
           CASE WHEN event_id % 5 <> 0 THEN 'key-' || event_id % 30 END AS dedupe_key, event_id % 3 <> 0 AS retryable, CASE WHEN event_id % 16 = 6 THEN event_id % 90 END AS retry_after FROM events)"""
_LOG_FROM = 1704067200000000


def _log(read):
    i = F.col("event_id")
    kinds = F.array(*map(F.lit, ("enqueue", "enqueue", "claim", "enqueue", "claim", "complete", "fail", "cancel")))
    us = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - _LOG_FROM) / 2000) + _LOG_FROM
    return read("events").select(
        F.col("user_id").cast("long").alias("queue"), i.cast("long").alias("event_id"), F.timestamp_micros(us).alias("at"), F.element_at(kinds, (i % 8 + 1).cast("int")).alias("kind"),
        F.when((i % 8).isin(0, 1, 3), i).alias("job"), F.when(i % 5 != 0, F.concat(F.lit("key-"), (i % 30).cast("string"))).alias("dedupe_key"),
        (i % 3 != 0).alias("retryable"), F.when(i % 16 == 6, i % 90).alias("retry_after"),
    )


_RUNNABLE = "(j.status IN ('pending', 'retry_scheduled') AND (j.not_before IS NULL OR j.not_before <= o.us)) OR (j.status = 'running' AND j.started < o.us - 300000000)"
_HOLDS = "j.key = o.dedupe_key AND j.status IN ('pending', 'running', 'retry_scheduled', 'completed')"
#: The queue as a recursive query: a list of all jobs of a queue, changed by its events one after another.
_QUEUE = f"""
WITH RECURSIVE {_LOG},
o AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY us, event_id) AS n FROM g),
s AS (
  SELECT NULL::BIGINT AS queue, NULL::BIGINT AS event_id, 0::BIGINT AS n, NULL::BIGINT AS job, NULL::VARCHAR AS before, NULL::VARCHAR AS after, NULL::INTEGER AS attempts, NULL::BIGINT AS not_before,
         []::STRUCT(id BIGINT, status VARCHAR, created BIGINT, started BIGINT, not_before BIGINT, attempts INTEGER, key VARCHAR)[] AS jobs
  UNION ALL
  SELECT queue, event_id, n, job, before, after, CASE WHEN job IS NULL THEN NULL ELSE attempts END, CASE WHEN job IS NULL THEN NULL ELSE wait_until END,
         CASE WHEN after IS NULL THEN jobs
              WHEN before IS NULL THEN list_append(jobs, struct_pack(id := job, status := 'pending', created := us, started := NULL::BIGINT, not_before := NULL::BIGINT, attempts := 0, key := dedupe_key))
              ELSE list_transform(jobs, lambda j: CASE WHEN j.id <> job THEN j ELSE struct_pack(id := j.id, status := after, created := j.created, started := CASE WHEN after = 'running' THEN us ELSE j.started END,
                                                                                                not_before := wait_until, attempts := attempts, key := j.key) END) END
  FROM (
    SELECT *, CASE WHEN after = 'retry_scheduled' THEN us + 1000000 * greatest(coalesce(retry_after, least(5 * 2 ** (attempts - 1), 60)::BIGINT), 1) WHEN after IS NULL THEN was.not_before END AS wait_until FROM (
      SELECT *, CASE WHEN kind = 'enqueue' THEN CASE WHEN was IS NULL THEN 'pending' END
                     WHEN kind = 'claim' THEN CASE WHEN was IS NOT NULL THEN 'running' END
                     WHEN kind = 'complete' THEN CASE WHEN before = 'running' THEN 'completed' END
                     WHEN kind = 'fail' THEN CASE WHEN before = 'running' THEN CASE WHEN retryable AND attempts < 4 THEN 'retry_scheduled' ELSE 'failed' END END
                     WHEN before IN ('pending', 'running', 'retry_scheduled', 'cancelled') THEN 'cancelled' END AS after FROM (
        SELECT *, was.status AS before, CASE WHEN kind = 'enqueue' AND was IS NULL THEN asked ELSE was.id END AS job,
               coalesce(was.attempts, 0) + CASE WHEN kind = 'fail' AND was.status = 'running' THEN 1 ELSE 0 END AS attempts FROM (
          SELECT o.queue, o.event_id, o.n, o.us, o.kind, o.dedupe_key, o.retryable, o.retry_after, o.job AS asked, coalesce(s.jobs, []) AS jobs,
                 CASE o.kind WHEN 'enqueue' THEN list_filter(s.jobs, lambda j: {_HOLDS})[1]
                             WHEN 'claim' THEN list_sort(list_transform(list_filter(s.jobs, lambda j: {_RUNNABLE}), lambda j: struct_pack(c := j.created, i := j.id, j := j)))[1].j
                             ELSE list_sort(list_transform(list_filter(s.jobs, lambda j: j.status = 'running'), lambda j: struct_pack(a := j.started, c := j.created, i := j.id, j := j)))[1].j END AS was
          FROM o JOIN s ON o.n = s.n + 1 AND (s.queue = o.queue OR s.n = 0))))))
SELECT queue, event_id, job, before, after, attempts, make_timestamp(not_before) AS not_before FROM s WHERE n > 0
"""


def _ntz(df):
    return df.withColumn("not_before", F.col("not_before").cast("timestamp_ntz"))


@query(_QUEUE)
def queue_replay(spark, read):
    return _ntz(queue.replay_batch(_log(read)))


@query(_QUEUE)
def queue_streamed(spark, read):
    log = _log(read)
    last = log.agg(F.max("at")).first()[0]
    end = (-1, -1, last.replace(year=last.year + 1), "end", None, None, None, None)
    return _ntz(ordered.replay(spark, log, "at", end, lambda rows: queue.queue_stream(rows, "1 day")))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 7200 SECOND THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT user_id AS key, min(ts) AS first, max(ts) AS last, count(*) AS touches FROM n GROUP BY user_id, session""")
def sessions_streamed(spark, read):
    events = read("events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max("ts")).first()[0]
    ended = ordered.replay(spark, events, "ts", (-1, -1, last.replace(year=last.year + 1)), lambda rows: sessions.expiring_sessions(rows, "user_id", "ts", 7200, "60 days"))
    return ended.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query(f"""WITH RECURSIVE changed AS (SELECT doc_id, lang, CASE WHEN l.quality IS NULL THEN text ELSE 'note ' || doc_id || chr(10) || text END AS text FROM documents LEFT JOIN labels l USING (doc_id)), {_CHUNKS.replace("FROM documents", "FROM changed")}
  SELECT c.doc_id, chunk_index, c.text, CASE WHEN l.doc_id IS NULL THEN c.lang END AS ai_summary FROM c LEFT JOIN labels l USING (doc_id)""")
def committed_texts(spark, read):
    """Documents and chunks in a versioned store, new texts for all labelled documents in one commit, read as a snapshot."""
    docs = read("documents").select("doc_id", "text", F.col("lang").alias("ai_summary"))
    cut = lambda d: chunking.chunk_documents(d).select("doc_id", "chunk_index", "text")
    store = versions.Store(spark, scratch_folder(spark), {"documents": "doc_id", "chunks": "doc_id"})
    store.create(documents=docs, chunks=cut(docs))
    changes = read("labels").select("doc_id").join(docs, "doc_id").select("doc_id", F.concat(F.lit("note "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("text"))
    now = versions.replace_texts(store, changes, cut)
    return store.read("chunks", now).join(store.read("documents", now).select("doc_id", "ai_summary"), "doc_id")


_WORDS = r"""w AS (SELECT doc_id, 1 AS page, i AS place, i // 64 AS block, i // 8 AS line, ws[i + 1] AS text FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents))),
  p AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY place) - 1 AS stop FROM w),
  f AS (SELECT doc_id, place, page, text, (stop - length(text))::BIGINT AS start, stop::BIGINT AS stop FROM p)"""


def _placed(read):
    """All words of all documents, eight a line."""
    ws = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    rows = read("documents").select("doc_id", F.posexplode(ws).alias("place", "text"))
    return rows.select("doc_id", F.lit(1).alias("page"), "place", F.floor(F.col("place") / 64).alias("block"), F.floor(F.col("place") / 8).alias("line"), "text")


@query(f'WITH {_WORDS} SELECT doc_id, place, start, stop FROM f')
def word_offsets(spark, read):
    return layout.word_offsets(_placed(read)).select("doc_id", "place", "start", F.col("end").alias("stop"))


@query(rf"""WITH {_WORDS}, x AS (SELECT doc_id, start, start + 40 + place % 3000 AS stop FROM f WHERE regexp_matches(text, '[0-9@]'))
  SELECT x.doc_id, x.start, x.stop, f.place FROM x JOIN f ON f.doc_id = x.doc_id AND f.start < x.stop AND f.stop > x.start""")
def span_words(spark, read):
    """Each word that a span touches; spans run from every word with a digit or an at sign over 40 to 3,039 places."""
    asked = _placed(read).withColumn("asked", F.col("text").rlike("[0-9@]"))
    words = materialise(layout.word_offsets(asked).select("doc_id", "page", "place", "start", "end", "asked"))  # both sides read it
    spans = words.filter("asked").select("doc_id", "page", "start", (F.col("start") + 40 + F.col("place") % 3000).alias("end"))
    return layout.span_words(spans, words.drop("asked")).select("doc_id", "start", F.col("end").alias("stop"), "place")


#: A line for every pattern: the line, what is found in it, its category, confidence and whether it is to be reviewed.
PLANTED = (
    ("Пишите ivan@mail.kz сегодня", "ivan@mail.kz", "EMAIL", 0.98, False),
    ("тел. +7 (701) 123-45-67", "+7 (701) 123-45-67", "PHONE", 0.96, False),
    ("Адрес: г. Алматы, ул. Абая, д. 5", "г. Алматы, ул. Абая, д. 5", "ADDRESS", 0.94, False),
    ("г. Астана, проспект Мәңгілік Ел, 55", "г. Астана, проспект Мәңгілік Ел, 55", "ADDRESS", 0.86, False),
    ("Заявитель: Петров П. П.", "Петров П. П.", "PERSON", 0.90, False),
    ("Фамилия, имя, отчество: Ахметов Серик Болатович", "Ахметов Серик Болатович", "PERSON", 0.90, False),
    ("Директор Иванов И. И.", "Иванов И. И.", "PERSON", 0.88, False),
    ("KZ86125KZT5004100100", "KZ86125KZT5004100100", "IBAN", 0.99, False),
    ("KZ00125KZT5004100100", "KZ00125KZT5004100100", "IBAN", 0.72, True),
    ("01.02.2024", "01.02.2024", "DATE", 0.90, False),
    ("договор № 15-А", "15-А", "DOC_ID", 0.94, False),
    ("приказ 77/5", "77/5", "DOC_ID", 0.90, False),
    ("ТОО «Альфа»", "ТОО «Альфа»", "ORG", 0.92, False),
    ("«Бета» ЖШС", "«Бета» ЖШС", "ORG", 0.92, False),
    ("акционерное общество «Гамма»", "акционерное общество «Гамма»", "ORG", 0.92, False),
    ("Министерство юстиции Республики Казахстан", "Министерство юстиции Республики Казахстан", "ORG", 0.86, False),
    ("Қазақстан Республикасының Әділет министрлігі", "Қазақстан Республикасының Әділет министрлігі", "ORG", 0.86, False),
    ("Алматы қаласының әкімдігі", "Алматы қаласының әкімдігі", "ORG", 0.86, False),
    ("акимат города Алматы", "акимат города Алматы", "ORG", 0.86, False),
    ("ИИН: 900101300007", "900101300007", "IIN", 0.99, False),
    ("ИИН: 123456789012", "123456789012", "IIN", 0.96, True),
    ("БИН 240140000001", "240140000001", "BIN", 0.99, False),
    ("ИИН/БИН 240140000001", "240140000001", "BIN", 0.99, False),
    ("900101300007", "900101300007", "IIN", 0.84, True),
    ("240140000001", "240140000001", "BIN", 0.90, False),
    ("4111 1111 1111 1111", "4111 1111 1111 1111", "PAYMENT_CARD", 0.98, False),
    ("карта 4111 1111 1111 1112", "4111 1111 1111 1112", "PAYMENT_CARD", 0.70, True),
    ("сумма 5 000 ₸", "5 000 ₸", "AMOUNT", 0.95, False),
)
#: Between the lines, so that no line's words are another's context.
_APART = "\n" + "=" * 100 + "\n"


@query(f"""WITH l AS (SELECT row_number() OVER () AS i, * FROM (VALUES {', '.join(f"('{line}', '{value}', '{c}', {conf}::DOUBLE, {str(review).lower()})" for line, value, c, conf, review in PLANTED)}) AS v(line, value, category, confidence, review_required)),
  p AS (SELECT *, i * {len(_APART)} + sum(length(line)) OVER (ORDER BY i) - length(line) + strpos(line, value) - 1 AS spot FROM l)
  SELECT doc_id, (length(text) + spot)::INTEGER AS start, (length(text) + spot + length(value))::INTEGER AS stop, category, confidence, review_required FROM documents, p""")
def pii_catalogue(spark, read):
    """Every pattern's line under every document's whole text: the spans found in the lines."""
    docs = read("documents").select("doc_id", F.concat("text", *[F.lit(_APART + line) for line, *_ in PLANTED]).alias("text"), F.length("text").alias("own"))
    found = privacy.detect(docs, kept=["own"]).select("doc_id", "own", F.inline("spans"))
    return found.filter("start >= own").select("doc_id", "start", F.col("end").alias("stop"), "category", "confidence", "review_required")


@query("""WITH RECURSIVE u AS (SELECT c_custkey AS owner, floor(greatest(c_acctbal, 0))::BIGINT * 100 AS used FROM customer),
  o AS (SELECT o_orderkey AS id, o_custkey AS owner, floor(o_totalprice)::BIGINT * 10 AS size, o_orderkey % 9 <> 0 AS flat, coalesce(used, 0) AS used, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders LEFT JOIN u ON owner = o_custkey),
  s AS (SELECT id, owner, n, size, flat, used AS before FROM o WHERE n = 1
    UNION ALL SELECT o.id, o.owner, o.n, o.size, o.flat, s.before + CASE WHEN s.flat AND s.before + s.size <= 10000000 THEN s.size ELSE 0 END FROM s JOIN o ON o.owner = s.owner AND o.n = s.n + 1)
  SELECT id, flat AND before + size <= 10000000 AS admitted, CASE WHEN NOT flat THEN 'not_flattened' WHEN before + size > 10000000 THEN 'quota' END AS reason, before AS used_before FROM s""")
def artifact_admission(spark, read):
    o = read("orders")
    requests = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("at"), (F.floor("o_totalprice") * 10).cast("long").alias("size"), (F.col("o_orderkey") % 9 != 0).alias("flattened"), F.lit(False).alias("selectable_text"))
    used = read("customer").select(F.col("c_custkey").alias("owner"), (F.floor(F.greatest("c_acctbal", F.lit(0))) * 100).alias("used"))
    return registration.admit(requests, used, 10_000_000).select("id", "admitted", "reason", "used_before")


@query("""SELECT doc_id AS artifact_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS hash_ok, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'ready_for_ai' ELSE 'failed' END AS status FROM documents""")
def artifact_digests(spark, read):
    """The gate over texts as files: every third was changed since it was registered, every fifth is gone."""
    texts = read("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    path = F.concat(F.lit("made/"), F.col("doc_id").cast("string"))
    made = registration.digests(texts.select(path.alias("path"), "content")).select(F.col("path").alias("stored_path"), F.lit("source").alias("source_path"), F.col("sha256").alias("artifact_sha256"), F.sha2(F.lit(b"s"), 256).alias("source_sha256"), F.substring("path", 6, 20).cast("long").alias("artifact_id"))
    later = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit(b"!"))).otherwise(F.col("content"))
    now = texts.filter("doc_id % 5 <> 0").select(path.alias("path"), later.alias("content")).unionByName(spark.range(1).select(F.lit("source").alias("path"), F.lit(b"s").alias("content")))
    ready = registration.with_hash_ok(made, now).withColumns({
        "status": F.lit("ready_for_ai"), "policy_version": F.lit("p2"), "detector_version": F.lit("d1"), "flattened": F.lit(True), "selectable_text": F.lit(False), "native_text_pages": F.lit(0),
        "passed": F.lit(True), "verification_completed": F.lit(True), "risks": F.array().cast("array<string>"),
    })
    return findings.gate(ready, "p2", "d1").select("artifact_id", "hash_ok", "status")


@query("""SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_returnflag = 'A' THEN '$.category: missing' WHEN l_returnflag = 'R' THEN '$.category: not_allowed' END, CASE WHEN l_linenumber = 1 THEN '$.severity: null' END,
    CASE WHEN l_linenumber = 2 THEN '$.page: not_integer' WHEN l_linenumber < 2 THEN '$.page: too_small' END, CASE WHEN length(l_linestatus) * l_partkey % 7 = 0 THEN '$.evidence: too_short' WHEN l_partkey % 7 = 1 THEN '$.evidence: too_long' END,
    CASE WHEN l_discount > 0.08 THEN '$.confidence: too_large' END], lambda x: x IS NOT NULL) AS wrong FROM lineitem""")
def answer_violations(spark, read):
    """Findings as a model might return them, against their schema."""
    number, flag, part = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_partkey") % 7
    answer = F.struct(
        F.when(flag == "N", "style").when(flag == "R", "other things").alias("category"), F.when(number != 1, "low").alias("severity"),
        F.when(number == 2, F.lit(2.5)).otherwise((number - 1).cast("double")).alias("page"), F.when(part == 0, "").when(part == 1, F.repeat(F.lit("x"), 501)).otherwise("seen").alias("evidence"),
        F.lit("why").alias("explanation"), (F.col("l_discount") * 12.5).alias("confidence"), F.lit("ocr").alias("basis"),
    )
    text = F.when(flag == "A", F.regexp_replace(F.to_json(answer, {"ignoreNullFields": "false"}), '"category":null,', "")).otherwise(F.to_json(answer, {"ignoreNullFields": "false"}))
    return read("lineitem").select("l_orderkey", "l_linenumber", answers.violations(text, answers.FINDING).alias("wrong"))
