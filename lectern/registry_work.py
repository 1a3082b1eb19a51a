"""Queries of the queue, artifacts, findings, reviews and stores over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import findings, jobs, layout, lifecycle, privacy, reports, review
from .registry import _CHUNKS, NOW, _chunks, query
from .sources import stores

_STAMP = f"TIMESTAMP '{NOW}'"


def _now():
    return F.lit(NOW).cast("timestamp")


def _ntz(df, *columns):
    """Times without zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_AI = """j AS (SELECT event_id AS id, user_id AS owner, ts AS created_at, ts AS started_at, ['pending', 'running', 'retry_scheduled', 'completed', 'failed', 'cancelled'][event_id % 6 + 1] AS status,
  (event_id % 5 + 1)::INTEGER AS attempts, event_id % 3 <> 0 AS retryable, CASE WHEN event_id % 4 = 0 THEN (event_id % 90)::INTEGER END AS retry_after,
  CASE WHEN event_id % 7 < 5 THEN 'file-' || event_id // 40 END AS remote_name, CASE WHEN event_id % 2 = 0 THEN 'gemini' ELSE 'local' END AS provider,
  CASE WHEN event_id % 7 < 4 THEN ts + INTERVAL 2 DAY END AS remote_expires_at, event_id % 11 = 0 AS worker_active, 'key-' || event_id % 500 AS dedupe_key, event_id % 800 AS artifact_id,
  'sha-' || event_id // 30 AS sha, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'retain_48h' END AS retention FROM events)"""


def _ai(read):
    i = F.col("event_id")
    states = F.array(*map(F.lit, ("pending", "running", "retry_scheduled", "completed", "failed", "cancelled")))
    ts = F.col("ts").cast("timestamp")
    return read("events").select(
        i.alias("id"), F.col("user_id").alias("owner"), ts.alias("created_at"), ts.alias("started_at"), F.element_at(states, (i % 6 + 1).cast("int")).alias("status"),
        (i % 5 + 1).cast("int").alias("attempts"), (i % 3 != 0).alias("retryable"), F.when(i % 4 == 0, (i % 90).cast("int")).alias("retry_after"),
        F.when(i % 7 < 5, F.concat(F.lit("file-"), F.floor(i / 40).cast("string"))).alias("remote_name"), F.when(i % 2 == 0, "gemini").otherwise("local").alias("provider"),
        F.when(i % 7 < 4, ts + F.expr("interval 2 days")).alias("remote_expires_at"), (i % 11 == 0).alias("worker_active"), F.concat(F.lit("key-"), (i % 500).cast("string")).alias("dedupe_key"),
        (i % 800).alias("artifact_id"), F.concat(F.lit("sha-"), F.floor(i / 30).cast("string")).alias("sha"), F.when(i % 5 == 0, "delete").otherwise("retain_48h").alias("retention"),
        F.lit(None).cast("timestamp").alias("not_before"), F.lit(None).cast("timestamp").alias("finished_at"),
    )


_USE = "(worker_active OR status IN ('pending', 'running', 'retry_scheduled'))"


@query(f"""WITH {_AI}, r AS (SELECT *, retryable AND attempts < 4 AS again, greatest(coalesce(retry_after, least(5 * pow(2, attempts - 1), 60)), 1) AS wait FROM j)
  SELECT id, CASE WHEN again THEN 'retry_scheduled' ELSE 'failed' END AS status, CASE WHEN again THEN {_STAMP} + to_seconds(wait::INTEGER) END AS not_before, CASE WHEN again THEN dedupe_key END AS dedupe_key FROM r""")
def provider_failures(spark, read):
    return _ntz(jobs.provider_failed(_ai(read), _now()), "not_before").select("id", "status", "not_before", "dedupe_key")


@query(f"""WITH {_AI}, b AS (SELECT provider, remote_name, count(*) FILTER ({_USE}) AS users FROM j WHERE remote_name IS NOT NULL GROUP BY ALL)
  SELECT id, status NOT IN ('completed', 'failed') AS allowed, CASE WHEN status NOT IN ('completed', 'failed') THEN 'cancelled' ELSE status END AS status,
         CASE WHEN status IN ('completed', 'failed') THEN dedupe_key END AS dedupe_key,
         status NOT IN ('completed', 'failed') AND j.remote_name IS NOT NULL AND coalesce(users, 0) - CASE WHEN {_USE} THEN 1 ELSE 0 END <= 0 AS delete_remote
  FROM j LEFT JOIN b USING (provider, remote_name)""")
def job_cancel(spark, read):
    return jobs.cancel(_ai(read), _now()).select("id", "allowed", "status", "dedupe_key", "delete_remote")


@query(f"""WITH {_AI}, g AS (SELECT DISTINCT provider, remote_name FROM j WHERE remote_expires_at <= {_STAMP} AND remote_name IS NOT NULL)
  SELECT id, CASE WHEN g.remote_name IS NULL THEN j.remote_name END AS remote_name FROM j LEFT JOIN g USING (provider, remote_name)""")
def remote_expiry(spark, read):
    return jobs.expire_remote(_ai(read), _now()).select("id", "remote_name")


@query(f"WITH {_AI} SELECT id, worker_active AND NOT (status = 'cancelled' AND started_at < {_STAMP} - INTERVAL 300 SECOND) AS worker_active FROM j")
def stale_cancelled(spark, read):
    return jobs.release_stale_cancelled(_ai(read), _now()).select("id", "worker_active")


@query(f"""WITH {_AI}, l AS (SELECT max(created_at) + INTERVAL 12 SECOND AS free FROM j WHERE provider IN ('gemini', 'hybrid') AND created_at <= {_STAMP})
  SELECT id, coalesce(free <= {_STAMP}, true) AS granted FROM j, l WHERE status = 'running'""")
def provider_quota(spark, read):
    all_jobs = _ai(read)
    asked = all_jobs.filter(F.col("created_at") <= _now()).select("provider", F.col("created_at").alias("requested_at"))
    return jobs.reserve_request(all_jobs.filter("status = 'running'"), asked, _now()).select("id", "granted")


@query("""WITH RECURSIVE o AS (SELECT event_id AS id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  s AS (SELECT id, user_id, n, ts AS starts_at FROM o WHERE n = 1 UNION ALL SELECT o.id, o.user_id, o.n, greatest(o.ts, s.starts_at + INTERVAL 7200 SECOND) FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
  SELECT id, starts_at FROM s""")
def request_spacing(spark, read):
    asked = read("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("provider"), F.col("ts").alias("asked_at"))
    return _ntz(jobs.space_requests(asked, 7200), "starts_at").select("id", "starts_at")


@query(f"""WITH o AS (SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 <> 0),
  a AS (SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey % 2 = 0)
  SELECT coalesce(o.document_id, a.document_id) AS document_id, CASE WHEN a.document_id IS NOT NULL AND coalesce(status NOT IN ('pending', 'running'), true) THEN 'pending' ELSE status END AS status,
         CASE WHEN a.document_id IS NOT NULL AND coalesce(status NOT IN ('pending', 'running'), true) THEN {_STAMP} ELSE created_at END AS created_at
  FROM o FULL JOIN a USING (document_id)""")
def job_upsert(spark, read):
    o = read("orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    table = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("document_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    asked = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("document_id"))  # every second order asks again: the case itself
    return _ntz(jobs.upsert_jobs(table, asked, "document_id", _now()), "created_at")


@query(f"""WITH {_AI}, h AS (SELECT dedupe_key, max_by(id, struct_pack(c := created_at, i := id)) AS id FROM j WHERE status IN ('pending', 'running', 'retry_scheduled', 'completed') GROUP BY dedupe_key)
  SELECT l_orderkey * 10 + l_linenumber AS request, h.id FROM lineitem LEFT JOIN h ON dedupe_key = 'key-' || l_orderkey % 700""")
def job_reuse(spark, read):
    asked = read("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request"), F.concat(F.lit("key-"), (F.col("l_orderkey") % 700).cast("string")).alias("dedupe_key"))
    return jobs.enqueue(_ai(read), asked)


@query(f"""WITH {_AI}, b AS (SELECT provider, remote_name FROM j WHERE remote_name IS NOT NULL AND {_USE} GROUP BY ALL),
  t AS (SELECT artifact_id, bool_or({_USE} OR b.remote_name IS NOT NULL) AS refused FROM j LEFT JOIN b USING (provider, remote_name) WHERE artifact_id < 400 GROUP BY artifact_id)
  SELECT id, artifact_id FROM j WHERE artifact_id NOT IN (SELECT artifact_id FROM t WHERE NOT refused)""")
def artifact_job_delete(spark, read):
    gone = spark.range(400).select(F.col("id").alias("artifact_id"))
    return jobs.delete_for_artifacts(_ai(read), gone)[0].select("id", "artifact_id")


@query(f"""WITH {_AI}, k AS (SELECT * FROM j WHERE retention = 'retain_48h'),
  p AS (SELECT a.id, b.id AS other_id FROM k a JOIN k b ON a.owner = b.owner AND a.sha = b.sha AND a.provider = b.provider AND a.id <> b.id
        WHERE b.remote_name IS NOT NULL AND (b.remote_expires_at IS NULL OR b.remote_expires_at > {_STAMP}) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id DESC) = 1)
  SELECT k.id, p.other_id FROM k LEFT JOIN p USING (id)""")
def remote_reuse(spark, read):
    return jobs.reusable_remote(_ai(read), _now())


@query(f"WITH {_AI} SELECT artifact_id, bool_or({_USE}) AS any_active, bool_or(remote_name IS NOT NULL) AS any_remote FROM j GROUP BY artifact_id")
def artifact_activity(spark, read):
    return jobs.activity(_ai(read), "artifact_id")


@query(f"""WITH {_AI} SELECT id, CASE status || ' ' || ['claim', 'complete', 'fail', 'retry', 'cancel', 'reclaim'][attempts + 1] WHEN 'running complete' THEN 'completed' WHEN 'running fail' THEN 'failed'
  WHEN 'running retry' THEN 'retry_scheduled' WHEN 'running reclaim' THEN 'running' WHEN 'pending cancel' THEN 'cancelled' WHEN 'running cancel' THEN 'cancelled' WHEN 'retry_scheduled cancel' THEN 'cancelled' WHEN 'cancelled cancel' THEN 'cancelled' END AS next FROM j""")
def job_transitions(spark, read):
    event = F.element_at(F.array(*map(F.lit, ("claim", "complete", "fail", "retry", "cancel", "reclaim"))), F.col("attempts") + 1)
    return _ai(read).select("id", jobs.advance(F.col("status"), event).alias("next"))


@query("""SELECT l_orderkey, l_linenumber, sha256('{"artifact_id":' || l_partkey || ',"model":' || CASE WHEN l_linenumber % 2 = 0 THEN 'null' ELSE '"m\\"1"' END || ',"task":"' || l_returnflag || '","user_id":' || l_suppkey || '}') AS key FROM lineitem""")
def dedupe_keys(spark, read):
    key = jobs.dedupe_key(user_id=F.col("l_suppkey"), task=F.col("l_returnflag"), model=F.when(F.col("l_linenumber") % 2 != 0, 'm"1'), artifact_id=F.col("l_partkey"))
    return read("lineitem").select("l_orderkey", "l_linenumber", key.alias("key"))


_TOOL = """t AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'completed' ELSE 'failed' END AS status, o_orderdate AS created_at, o_orderkey % 900 AS artifact_id, o_custkey % 50 AS document_id, o_orderkey % 6 = 0 AS hidden FROM orders),
  v AS (SELECT p_partkey AS artifact_id FROM part WHERE p_size % 10 = 0)"""


def _tool(read):
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "completed").otherwise("failed")
    table = read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 900).alias("artifact_id"), (F.col("o_custkey") % 50).alias("document_id"), (F.col("o_orderkey") % 6 == 0).alias("hidden"))
    artifacts = read("part").select(F.col("p_partkey").alias("artifact_id"), F.when(F.col("p_size") % 10 == 0, "verifying").otherwise("ready_for_ai").alias("status"))
    return table, artifacts


@query(f"""WITH {_TOOL}, a AS (SELECT t.*, CASE WHEN status IN ('pending', 'running', 'review') OR artifact_id IN (SELECT artifact_id FROM v) THEN 'active' WHEN NOT hidden THEN 'history' END AS part FROM t),
  r AS (SELECT id, part, row_number() OVER (PARTITION BY owner, part ORDER BY created_at DESC, id DESC)::INTEGER AS place FROM a WHERE part IS NOT NULL)
  SELECT * FROM r WHERE part = 'active' OR place <= 5""")
def tool_history(spark, read):
    return reports.job_history(*_tool(read))


@query(f"WITH {_TOOL} SELECT id FROM t WHERE id IN (SELECT id FROM t ORDER BY created_at DESC, id DESC LIMIT 50) OR status = 'running' OR artifact_id IN (SELECT artifact_id FROM v)")
def tool_jobs_shown(spark, read):
    table, artifacts = _tool(read)
    return reports.recent_or_active(table, F.col("status") == "running", artifacts=artifacts).select("id")


@query("SELECT doc_id, source AS owner FROM documents WHERE source = 'src1'")
def owner_documents(spark, read):
    return reports.owned(read("documents").select("doc_id", F.col("source").alias("owner")), "src1").orderBy(F.desc("doc_id"))


@query("SELECT p_partkey AS artifact_id, d.doc_id IS NOT NULL AS source_found FROM part LEFT JOIN documents d ON d.doc_id = p_partkey AND d.source = 'src' || p_size % 20")
def artifact_sources(spark, read):
    made = read("part").select(F.col("p_partkey").alias("artifact_id"), F.col("p_partkey").alias("source_id"), F.concat(F.lit("src"), (F.col("p_size") % 20).cast("string")).alias("owner"))
    return reports.with_source(made, read("documents").select("doc_id", F.col("source").alias("owner"))).select("artifact_id", "source_found")


_PAGES = "p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_quantity > 10 AS checked, CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS failures FROM lineitem)"


@query(f"""WITH {_PAGES} SELECT doc_id, count(*) AS page_count, array_to_string(list_sort(list(page) FILTER (NOT checked)), ',') AS unchecked, sum(failures)::BIGINT AS failure_count,
  round(count(*) FILTER (checked) / greatest(count(*), 1) * 100)::INTEGER AS percent, count(*) FILTER (NOT checked) = 0 AND sum(failures) = 0 AS complete FROM p GROUP BY doc_id""")
def scan_coverage(spark, read):
    pages = read("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") > 10).alias("checked"), (F.col("l_tax") > 0.07).cast("int").alias("failures"))
    rolled = findings.coverage(pages)
    unchecked = F.when(F.size("unchecked_pages") > 0, F.array_join(F.transform("unchecked_pages", lambda p: p.cast("string")), ","))
    return rolled.select("doc_id", "page_count", unchecked.alias("unchecked"), "failure_count", "percent", "complete")


_ARTIFACT = """a AS (SELECT p_partkey AS artifact_id, p_size % 9 <> 0 AS flattened, CASE WHEN p_size % 8 = 0 THEN NULL ELSE p_size % 7 = 0 END AS selectable_text, p_size % 3 // 2 AS native_text_pages, p_partkey % 10 // 9 AS residual_count,
  p_partkey % 6 // 5 AS remaining_count, p_partkey % 13 // 12 AS unsafe_item_count, p_size % 10 // 9 AS failure_count, p_size % 11 // 10 AS unchecked_count, p_partkey FROM part),
  w AS (SELECT *, list_filter([CASE WHEN NOT flattened THEN 'protected_pdf_not_flattened' END, CASE WHEN coalesce(selectable_text, true) OR native_text_pages > 0 THEN 'selectable_text_present' END], lambda x: x IS NOT NULL) AS f FROM a),
  z AS (SELECT *, list_concat(f, list_filter([CASE WHEN residual_count > 0 THEN 'selected_text_still_present' END, CASE WHEN remaining_count > 0 THEN 'privacy_findings_remain' END, CASE WHEN unsafe_item_count > 0 THEN 'unsafe_pdf_structure' END,
    CASE WHEN failure_count > 0 THEN 'privacy_detector_failed' END, CASE WHEN unchecked_count > 0 THEN 'pages_not_verified' END], lambda x: x IS NOT NULL)) AS r FROM w)"""


def _artifacts(read):
    s, k = F.col("p_size"), F.col("p_partkey")
    every = lambda c, n: F.floor(c % n / (n - 1)).cast("int")
    return read("part").select(
        k.alias("artifact_id"), (s % 9 != 0).alias("flattened"), F.when(s % 8 != 0, s % 7 == 0).alias("selectable_text"), every(s, 3).alias("native_text_pages"), every(k, 10).alias("residual_count"),
        every(k, 6).alias("remaining_count"), every(k, 13).alias("unsafe_item_count"), every(s, 10).alias("failure_count"), every(s, 11).alias("unchecked_count"),
    )


@query(f"WITH {_ARTIFACT} SELECT artifact_id, array_to_string(r, ',') AS risks, len(r) = 0 AS passed, CASE WHEN len(r) = 0 THEN 'ready_for_ai' ELSE 'needs_review' END AS status FROM z")
def artifact_verification(spark, read):
    return findings.verify(_artifacts(read)).select("artifact_id", F.array_join("risks", ",").alias("risks"), "passed", "status")


@query(f"""WITH {_ARTIFACT}, g AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'needs_review' ELSE 'ready_for_ai' END AS was, list_concat(f, list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'privacy_policy_version_outdated' END,
    CASE WHEN len(r) > 0 THEN 'verification_not_passed' END, CASE WHEN unchecked_count > 0 THEN 'verification_incomplete' END], lambda x: x IS NOT NULL)) AS found FROM z)
  SELECT artifact_id, was = 'ready_for_ai' AND len(found) = 0 AND p_partkey % 7 <> 0 AS allowed,
         CASE WHEN was <> 'ready_for_ai' THEN was WHEN len(found) > 0 THEN 'needs_review' WHEN p_partkey % 7 = 0 THEN 'failed' ELSE was END AS status,
         array_to_string(CASE WHEN was <> 'ready_for_ai' THEN r ELSE list_sort(list_distinct(list_concat(r, found, CASE WHEN len(found) = 0 AND p_partkey % 7 = 0 THEN ['integrity_check_failed'] ELSE [] END))) END, ',') AS risks FROM g""")
def artifact_gate(spark, read):
    k = F.col("artifact_id")
    made = findings.verify(_artifacts(read)).withColumns({
        "status": F.when(k % 5 == 0, "needs_review").otherwise("ready_for_ai"), "policy_version": F.when(k % 4 == 0, "p1").otherwise("p2"), "detector_version": F.lit("d1"),
        "verification_completed": F.col("unchecked_count") == 0, "hash_ok": k % 7 != 0,
    })
    return findings.gate(made, "p2", "d1").select("artifact_id", "allowed", "status", F.array_join("risks", ",").alias("risks"))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS page, l_returnflag AS message, min(l_partkey) AS place FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag""")
def failure_dedupe(spark, read):
    nothing = lambda c: F.lit(None).cast("string").alias(c)
    rows = read("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit("ocr").alias("detector"), nothing("language"), F.lit("native").alias("source"), nothing("category"), F.col("l_returnflag").alias("message"), F.col("l_partkey").alias("place"))
    return findings.distinct_failures(rows).select("doc_id", "page", "message", "place")


def _boxes(read):
    kinds = F.element_at(F.array(*map(F.lit, ("EMAIL", "PERSON", "IIN", "DATE"))), F.col("l_linenumber") % 4 + 1)
    x, y = (F.col("l_partkey") % 7 * 10).cast("double"), (F.col("l_suppkey") % 3 * 10).cast("double")
    return read("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("id"), (F.col("l_linenumber") % 2 + 1).alias("page"), kinds.alias("category"), F.lit("personal").alias("group"), F.col("l_discount").alias("confidence"), x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 9).alias("y1"), F.col("l_returnflag").alias("text"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("place"))


_SAME = "greatest(least(k.x1, o.x1) - greatest(k.x0, o.x0), 0) * greatest(least(k.y1, o.y1) - greatest(k.y0, o.y0), 0) / greatest(least((k.x1 - k.x0) * (k.y1 - k.y0), (o.x1 - o.x0) * (o.y1 - o.y0)), 1) > 0.75"


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS doc_id, 'f' || l_linenumber AS id, l_linenumber % 2 + 1 AS page, ['EMAIL', 'PERSON', 'IIN', 'DATE'][l_linenumber % 4 + 1] AS category, l_discount AS c,
    (l_partkey % 7 * 10)::DOUBLE AS x0, (l_suppkey % 3 * 10)::DOUBLE AS y0, (l_partkey % 7 * 10 + 12)::DOUBLE AS x1, (l_suppkey % 3 * 10 + 9)::DOUBLE AS y1 FROM lineitem),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE category {' '.join(f"WHEN '{c}' THEN {privacy.TAXONOMY[c][1]}" for c in ('EMAIL', 'PERSON', 'IIN', 'DATE'))} END DESC, c DESC, y0, x0, id, x1, y1) AS n FROM b),
  s AS (SELECT doc_id, page, n, id, category, x0, y0, true AS stays, [struct_pack(x0, y0, x1, y1)] AS kept FROM o WHERE n = 1
    UNION ALL SELECT doc_id, page, n, id, category, x0, y0, fresh, CASE WHEN fresh THEN list_append(kept, struct_pack(x0, y0, x1, y1)) ELSE kept END
    FROM (SELECT o.*, s.kept, len(list_filter(s.kept, lambda k: {_SAME})) = 0 AS fresh FROM s JOIN o ON o.doc_id = s.doc_id AND o.page = s.page AND o.n = s.n + 1))
  SELECT doc_id, 'finding-' || row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, id) AS id, page, category, x0, y0 FROM s WHERE stays""")
def finding_boxes(spark, read):
    return findings.number_findings(findings.drop_same_boxes(_boxes(read))).select("doc_id", "id", "page", "category", "x0", "y0")


_LABEL_SQL = "CASE category " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in privacy.LABELS.items()) + " ELSE 'Скрыто' END"


@query(f"""WITH f AS (SELECT l_orderkey AS doc_id, 'f' || l_linenumber AS id, ['EMAIL', 'PERSON', 'IIN', 'DATE'][l_linenumber % 4 + 1] AS category, lower(l_returnflag) AS v, l_linenumber * 1000000 + l_partkey AS place FROM lineitem),
  m AS (SELECT doc_id, category, v, min(place) AS first FROM f GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY first, v) AS i FROM m)
  SELECT doc_id, id, {_LABEL_SQL} || CASE WHEN category = 'PERSON' THEN ' ' || chr((64 + i)::INTEGER) ELSE '' END AS label FROM f JOIN n USING (doc_id, category, v)""")
def finding_labels(spark, read):
    return privacy.replacement_labels(_boxes(read))


@query("""SELECT l_orderkey AS doc_id, bool_or(l_linenumber > 5 OR l_quantity + l_discount * 500 > 100.001) OR count(*) > count(DISTINCT l_linenumber % 6) AS invalid FROM lineitem GROUP BY l_orderkey""")
def selection_check(spark, read):
    chosen = read("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 6).cast("string").alias("id"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x"), F.lit(1.0).alias("y"), (F.col("l_discount") * 500).alias("w"), F.lit(2.0).alias("h"))
    counts = read("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(5).alias("page_count"))
    return findings.selection_errors(chosen, chosen, counts)


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS page, round_even(CASE WHEN l_linenumber % 2 = 0 THEN 0.95::DOUBLE ELSE least(0.95::DOUBLE, greatest(l_quantity, 1) / 100) END, 2) AS confidence,
  l_linenumber % 2 <> 0 OR round_even(CASE WHEN l_linenumber % 2 = 0 THEN 0.95::DOUBLE ELSE least(0.95::DOUBLE, greatest(l_quantity, 1) / 100) END, 2) < 0.9 AS review_required, round(l_quantity / 600.0::DOUBLE * 100, 3) AS x FROM lineitem""")
def finding_build(spark, read):
    i = F.col("l_linenumber")
    spans = read("lineitem").select(F.col("l_orderkey").alias("doc_id"), i.alias("page"), F.lit("EMAIL").alias("category"), F.lit("personal").alias("group"), F.lit(0.95).alias("confidence"), F.lit(False).alias("review_required"), F.when(i % 2 != 0, F.col("l_quantity")).alias("layer_confidence"), F.col("l_quantity").alias("x0"), F.lit(1.0).alias("y0"), (F.col("l_quantity") + 10).alias("x1"), F.lit(9.0).alias("y1"))
    pages = read("lineitem").select(F.col("l_orderkey").alias("doc_id"), i.alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).distinct()
    return findings.build_findings(spans, pages).select("doc_id", "page", "confidence", "review_required", "x")


def _context_chunks(read):
    return _chunks(read).withColumns({"extraction_method": F.lit("native"), "extraction_quality": F.when(F.col("lang") == "en", "high").otherwise("medium"), "confidence": F.when(F.col("lang") == "de", 87.5), "uncertain_region_count": F.lit(0)})


_FACTS = "'extraction=native{0}quality=' || CASE WHEN lang = 'en' THEN 'high' ELSE 'medium' END || '{0}confidence=' || CASE WHEN lang = 'de' THEN '87.5' ELSE 'n/a' END || '{0}uncertain_regions=0]' || chr(10) || text"


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, sha256('[chunk ' || chunk_index || ', page 1, ' || {_FACTS.format(', ')}) AS retrieval, sha256('[chunk=' || chunk_index || '; страница 1; ' || {_FACTS.format('; ')}) AS review FROM c")
def context_headers(spark, read):
    return _context_chunks(read).select("doc_id", "chunk_index", F.sha2(review.retrieval_context(), 256).alias("retrieval"), F.sha2(review.review_context(), 256).alias("review"))


@query(f"""WITH RECURSIVE {_CHUNKS}, s AS (SELECT doc_id, chunk_index, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS upto FROM c)
  SELECT doc_id, chunk_index FROM s WHERE chunk_index = 0 OR upto <= 8000""")
def budget_chunks(spark, read):
    return review.within_budget(_chunks(read), ["doc_id"], ["chunk_index"], F.length("text"), review.RETRIEVAL_CHARS).select("doc_id", "chunk_index")


#: Contexts of a document in order, without what a chunk shares with the one before.
_CONTEXTS = f"""{_CHUNKS}, p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM c),
  v AS (SELECT *, coalesce(list_max(list_filter(range(20, 151), lambda k: before IS NOT NULL AND k <= length(before) AND k <= length(text) AND ends_with(before, text[1:k]))), 0) AS overlap FROM p),
  e AS (SELECT * REPLACE (CASE WHEN overlap > 0 THEN regexp_replace(text[overlap + 1:], '^\\s+', '') ELSE text END AS text) FROM v),
  y AS (SELECT doc_id, list('[chunk=' || chunk_index || '; страница 1; ' || {_FACTS.format('; ')} ORDER BY chunk_index) AS ctx, sum(length(text))::BIGINT AS total_chars FROM e WHERE text <> '' GROUP BY doc_id)"""


@query(f"""WITH RECURSIVE {_CONTEXTS},
  l AS (SELECT *, list_sum(list_transform(ctx, lambda t: length(t))) AS chars FROM y),
  k AS (SELECT *, greatest(1, least(len(ctx), 50000 // greatest(chars // len(ctx), 1)))::BIGINT AS k FROM l),
  s AS (SELECT *, list_transform(list_sort(list_distinct(list_transform(range(k), lambda i: round_even(i * (len(ctx) - 1) / greatest(k - 1, 1), 0)::BIGINT))), lambda i: ctx[i + 1]) AS picked FROM k),
  j AS (SELECT *, coalesce(list_max(list_filter(range(len(picked)), lambda j: coalesce(list_sum(list_transform(picked[1:j], lambda t: length(t))), 0) + length(ctx[-1]) + 2 * j <= 50000)), 0) AS j FROM s),
  h AS (SELECT *, CASE WHEN chars + 2 * (len(ctx) - 1) <= 50000 THEN ctx WHEN k = 1 THEN [ctx[1][1:50000]] ELSE list_append(picked[1:j], ctx[-1]) END AS chosen FROM j),
  t AS (SELECT *, array_to_string(chosen, chr(10) || chr(10)) AS prompt FROM h)
  SELECT doc_id, prompt[1:50000] AS prompt, total_chars, CASE WHEN complete THEN total_chars ELSE least(total_chars, 50000) END AS reviewed_chars, complete
  FROM (SELECT *, len(chosen) = len(ctx) AND length(prompt) <= 50000 AS complete FROM t)""")
def review_quick(spark, read):
    return review.quick_review(_context_chunks(read))


@query(f"""WITH RECURSIVE {_CONTEXTS},
  b AS (SELECT doc_id, total_chars, list_reduce(list_transform(ctx, lambda t: [t]), lambda s, t: CASE WHEN length(s[-1]) + 2 + length(t[1]) <= 10000 THEN list_append(s[:len(s) - 1], s[-1] || chr(10) || chr(10) || t[1]) ELSE list_concat(s, t) END) AS batches FROM y)
  SELECT doc_id, batches, total_chars, len(batches) > 6 AS too_large FROM b""")
def review_thorough(spark, read):
    return review.thorough_review(_context_chunks(read))


@query(f"""WITH RECURSIVE {_CHUNKS}, t AS (SELECT doc_id, chunk_index, length(text) AS n, sum(len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x = 'the')) * 2 + len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x = 'und'))) AS score FROM c GROUP BY ALL),
  k AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS most FROM t), o AS (SELECT *, row_number() OVER w AS place, sum(n) OVER w AS upto FROM k WHERE score > 0 OR most = 0 WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, chunk_index ROWS UNBOUNDED PRECEDING)),
  v AS (SELECT *, min(CASE WHEN upto > 8000 AND place > 1 THEN place END) OVER (PARTITION BY doc_id) AS over FROM o)
  SELECT doc_id, chunk_index, score::BIGINT AS score FROM v WHERE place <= 5 AND (over IS NULL OR place < over)""")
def term_overlap_topk(spark, read):
    return review.term_overlap(_chunks(read), spark.createDataFrame([("the", 2), ("und", 1)], "term string, weight int")).withColumn("score", F.col("score").cast("long"))


@query("""SELECT conv_id, array_to_string(list_transform(list_filter(list(struct_pack(r := trim(role), c := regexp_replace(text, '^\\s+|\\s+$', '', 'g')[1:1500]) ORDER BY turn)[greatest(count(*) - 11, 1)::BIGINT:count(*)], lambda m: m.r IN ('user', 'assistant') AND m.c <> ''), lambda m: m.r || ': ' || m.c), chr(10)) AS lines FROM conversations GROUP BY conv_id""")
def chat_history(spark, read):
    turns = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    return turns.select("conv_id", review.history_lines(F.col("h")).alias("lines"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) <= 1000 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS message FROM conversations""")
def message_limits(spark, read):
    return read("conversations").select("conv_id", "turn", T.valid_message(F.col("text"), review.QUESTION_CHARS).alias("message"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 25.4::DOUBLE / 72, 1) AS mm, ceil(l_quantity * 300 / 72)::INTEGER AS px, CASE WHEN l_linenumber % 2 = 0 THEN 'completed' WHEN l_returnflag = 'A' THEN 'ocr' ELSE 'extracting' END AS stage FROM lineitem""")
def page_units(spark, read):
    status = F.when(F.col("l_linenumber") % 2 == 0, "processed").otherwise("analyzing")
    stage = F.when(F.col("l_returnflag") == "A", "ocr").otherwise("other")
    return read("lineitem").select("l_orderkey", "l_linenumber", T.points_to_mm(F.col("l_quantity")).alias("mm"), T.pixels(F.col("l_quantity"), F.lit(300)).alias("px"), T.analysis_stage(status, stage).alias("stage"))


@query("""SELECT p_partkey, CASE WHEN p_partkey * 700 < 1024 THEN p_partkey * 700 || ' B' WHEN p_partkey * 700 < 10240 THEN printf('%.1f', round(p_partkey * 700 / 1024.0::DOUBLE, 1)) || ' KB' WHEN p_partkey * 700 < 1048576 THEN round(p_partkey * 700 / 1024.0::DOUBLE)::BIGINT || ' KB' WHEN p_partkey * 700 < 10485760 THEN printf('%.1f', round(p_partkey * 700 / 1048576.0::DOUBLE, 1)) || ' MB' ELSE round(p_partkey * 700 / 1048576.0::DOUBLE)::BIGINT || ' MB' END AS bytes FROM part""")
def shown_sizes(spark, read):
    return read("part").select("p_partkey", T.format_bytes(F.col("p_partkey") * 700).alias("bytes"))


@query("""SELECT p_partkey, list_filter([CASE WHEN p_size * 2 < 85 THEN 'mean_confidence_below_high_threshold' END, CASE WHEN p_size / 100.0 > 0.10 THEN 'low_confidence_word_ratio_above_retry_threshold' END, CASE WHEN p_size % 2 = 0 THEN 'insufficient_text_signal' END], lambda x: x IS NOT NULL) AS reasons,
  p_size * 2 - 40 * (p_size / 100.0::DOUBLE) + least(p_partkey / 50.0::DOUBLE, 5) AS score FROM part""")
def ocr_candidates(spark, read):
    low = F.col("p_size") / F.lit(100.0)
    return read("part").select("p_partkey", layout.retry_reasons(F.col("p_size") * 2, low, F.col("p_size") % 2 != 0).alias("reasons"), layout.candidate_score(F.col("p_size") * 2, low, F.col("p_partkey")).alias("score"))


@query("""WITH c AS (SELECT o_custkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, replace(o_orderpriority, '-', '|') || CASE WHEN o_orderstatus = 'P' THEN ' [UNCERTAIN_OCR]' ELSE '' END AS v FROM orders),
  r AS (SELECT t, i // 3 AS r, max(i // 3) OVER (PARTITION BY t) AS last, '| ' || array_to_string(list_transform(range(0, least(3, count(*) OVER (PARTITION BY t))), lambda k: ''), '') AS x, i % 3 AS k, replace(v, '|', '\\|') AS v, least(3, count(*) OVER (PARTITION BY t)) AS w FROM c),
  l AS (SELECT t, r, any_value(w) AS w, list(v ORDER BY k) AS vs FROM r GROUP BY t, r),
  m AS (SELECT t, r, w, '| ' || array_to_string(list_concat(vs, list_transform(range(0, w - len(vs)), lambda k: '')), ' | ') || ' |' AS line FROM l)
  SELECT t AS table_id, string_agg(line || CASE WHEN r = 0 THEN chr(10) || '| ' || array_to_string(list_transform(range(0, w), lambda k: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY r) AS text FROM m GROUP BY t""")
def markdown_grid(spark, read):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    cells = read("orders").select(F.col("o_custkey").alias("table_id"), i.alias("i"), F.translate("o_orderpriority", "-", "|").alias("text"), (F.col("o_orderstatus") == "P").alias("uncertain"))
    return layout.markdown_tables(cells.select("table_id", F.floor(F.col("i") / 3).cast("int").alias("row"), (F.col("i") % 3).cast("int").alias("column"), "text", "uncertain"))


@query("""SELECT vec_id AS doc_id, CASE WHEN len(embedding) <> 64 THEN 'wrong_size' WHEN list_max(list_transform(embedding, lambda x: abs(x))) = 0 THEN 'zero' END AS problem FROM embeddings""")
def vector_check(spark, read):
    return stores.valid_vectors(read("embeddings"), 64).select(F.col("vec_id").alias("doc_id"), "problem")


@query("SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'note ' || doc_id ELSE text END AS text, CASE WHEN quality IS NULL THEN lang END AS ai_summary FROM documents LEFT JOIN labels USING (doc_id)")
def text_overwrite(spark, read):
    docs = read("documents").select("doc_id", "text", F.col("lang").alias("ai_summary"))
    changes = read("labels").select("doc_id", F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("text"))
    chunks = spark.createDataFrame([], "doc_id long, chunk_index int, text string")
    return stores.overwrite_texts(docs, chunks, changes, lambda c: c.withColumn("chunk_index", F.lit(0)))[0]


@query("SELECT o_orderkey AS id, CASE WHEN p_partkey IS NULL THEN o_orderkey % 900 END AS artifact_id FROM orders LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 20) ON p_partkey = o_orderkey % 900")
def artifact_delete(spark, read):
    table, artifacts = _tool(read)
    gone = read("part").filter("p_size < 20").select(F.col("p_partkey").alias("artifact_id"))
    return stores.delete_artifacts(artifacts, table.withColumns({"result_path": F.lit("x"), "result_size": F.lit(1)}), gone)[1].select("id", "artifact_id")


@query("SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN source END, 'claimed') AS owner FROM documents")
def ownerless_claim(spark, read):
    return stores.claim_ownerless(read("documents").select("doc_id", F.when(F.col("lang") == "en", F.col("source")).alias("owner")), "claimed")[0]


@query("SELECT sha256('t' || c_custkey) AS token_hash, CASE WHEN c_acctbal > 0 THEN c_custkey END AS user_id FROM customer")
def session_lookup(spark, read):
    c = read("customer")
    token = F.concat(F.lit("t"), F.col("c_custkey").cast("string"))
    held = c.select(F.sha2(token, 256).alias("token_hash"), F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("expires_at"))
    found = stores.session_user(held, c.select(F.col("c_custkey").alias("user_id")), c.select(token.alias("token")), F.lit(0.0))
    return found.select(F.sha2("token", 256).alias("token_hash"), "user_id")


@query("SELECT DISTINCT lower(c_mktsegment) AS normalized FROM customer")
def user_names(spark, read):
    none = spark.createDataFrame([("machinery",)], "normalized string")
    return stores.add_users(none, read("customer").select(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")).alias("name")))


@query(f"""WITH {_AI}, a AS (SELECT p_partkey AS artifact_id, p_partkey % 100 AS source_document_id FROM part),
  b AS (SELECT provider, remote_name FROM j WHERE remote_name IS NOT NULL AND {_USE} GROUP BY ALL),
  t AS (SELECT artifact_id, bool_or({_USE} OR b.remote_name IS NOT NULL) AS refused FROM j LEFT JOIN b USING (provider, remote_name) GROUP BY artifact_id),
  r AS (SELECT DISTINCT source_document_id AS doc_id FROM a JOIN t USING (artifact_id) WHERE refused),
  g AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM r))
  SELECT 'documents' AS name, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)
  UNION ALL SELECT 'chunks', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM g)
  UNION ALL SELECT 'tool_jobs', o_orderkey FROM orders WHERE o_custkey % 50 NOT IN (SELECT doc_id FROM g)
  UNION ALL SELECT 'artifacts', artifact_id FROM a WHERE source_document_id NOT IN (SELECT doc_id FROM g)
  UNION ALL SELECT 'ai_jobs', id FROM j WHERE artifact_id NOT IN (SELECT artifact_id FROM a WHERE source_document_id IN (SELECT doc_id FROM g))
  UNION ALL SELECT 'refused', doc_id FROM r WHERE doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM documents)""")
def document_cascade(spark, read):
    """Every second document with all that hangs on it, but those whose artifacts are in use."""
    docs = read("documents").select("doc_id")
    artifacts = read("part").select(F.col("p_partkey").alias("artifact_id"), (F.col("p_partkey") % 100).alias("source_document_id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("stored_path"))
    tools = read("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("source_document_id"), F.lit(None).cast("string").alias("result_path"))
    left, _, refused = stores.delete_documents(docs.filter("doc_id % 2 = 0"), docs, read("labels").select("doc_id"), docs, tools, artifacts, _ai(read))
    keys = {"documents": "doc_id", "chunks": "doc_id", "tool_jobs": "id", "artifacts": "artifact_id", "ai_jobs": "id"}
    out = refused.select(F.lit("refused").alias("name"), F.col("doc_id").alias("id"))
    for name, key in keys.items():
        out = out.unionByName(left[name].select(F.lit(name).alias("name"), F.col(key).alias("id")))
    return out


@query("""SELECT l_orderkey AS doc_id, bool_or(l_linenumber > 4) AS invalid FROM lineitem GROUP BY l_orderkey""")
def selection_by_id(spark, read):
    """Selections by id alone: an order's lines beyond the fourth are no findings."""
    chosen = read("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("id"), F.lit(1).alias("page"), *[F.lit(None).cast("double").alias(c) for c in "xywh"])
    known = read("lineitem").filter("l_linenumber <= 4").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("id"))
    counts = read("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(5).alias("page_count"))
    return findings.selection_errors(chosen, known, counts)


@query(f"""WITH {_AI} SELECT id, CASE WHEN provider IN ('local', 'hybrid') AND attempts = 4 THEN 'local_model_changed' WHEN provider <> 'local' AND NOT (retryable AND artifact_id % 3 <> 0) THEN 'consent_required'
  WHEN provider <> 'local' AND id % 9 = 0 THEN 'terms_changed' WHEN provider <> 'local' AND attempts = 5 THEN 'external_model_changed' END AS refused FROM j""")
def consent_held(spark, read):
    old = lambda k: F.when(F.col("attempts") == k, "old").when(F.col("attempts") == 1, None).otherwise("new")
    agreed = _ai(read).withColumns({"external_processing": F.col("retryable"), "terms_acknowledged": F.col("artifact_id") % 3 != 0, "service_tier": F.when(F.col("id") % 9 != 0, "t1"), "local_model": old(4), "external_model": old(5)})
    return lifecycle.held_consent(agreed, "t1", {"local": "new", "external": "new"}).select("id", "refused")


@query(f"""WITH {_AI}, u AS (SELECT provider, remote_name FROM j WHERE remote_name IS NOT NULL AND {_USE} GROUP BY ALL),
  d AS (SELECT DISTINCT j.provider, j.remote_name FROM j LEFT JOIN u USING (provider, remote_name) WHERE j.remote_name IS NOT NULL AND status IN ('completed', 'failed', 'cancelled') AND retention <> 'retain_48h' AND u.remote_name IS NULL),
  r AS (SELECT *, CASE WHEN substr(remote_name, 6)::INTEGER % 3 = 0 THEN 500 WHEN substr(remote_name, 6)::INTEGER % 3 = 1 THEN 404 END AS code FROM d)
  SELECT id, CASE WHEN code IS NULL AND r.provider IS NOT NULL OR code = 404 THEN NULL ELSE j.remote_name END AS remote_name,
         CASE WHEN r.provider IS NULL THEN 'pending' WHEN code = 500 THEN 'failed' ELSE 'deleted' END AS cleanup_status, CASE WHEN code = 500 THEN 'before {lifecycle.WARNING.replace("'", "''")}' ELSE 'before' END AS public_error,
         CASE WHEN code = 500 THEN 'remote_delete_failed' END AS error_code, CASE WHEN code = 500 THEN 'Remote cleanup failed: no' END AS private_error
  FROM j LEFT JOIN r USING (provider, remote_name)""")
def remote_removal(spark, read):
    """Copies that nobody needs are removed: a third of the providers' answers is an error, a third says gone before."""
    text = lambda v: F.lit(v).cast("string")
    held = _ai(read).withColumns({"remote_uri": text(None), "remote_started_at": _now(), "cleanup_status": text("pending"), "cleanup_error": text(None), "public_error": text("before"), "error_code": text(None), "private_error": text(None)})
    number = F.substring("remote_name", 6, 20).cast("int") % 3
    answers = lifecycle.removals_due(held).withColumn("code", F.when(number == 0, 500).when(number == 1, 404)).withColumn("message", F.lit("no"))
    return lifecycle.removed(held, answers).select("id", "remote_name", "cleanup_status", "public_error", "error_code", "private_error")


@query("""SELECT o_orderkey AS id, CASE WHEN d.doc_id IS NULL THEN 'failed' ELSE 'running' END AS status, lang, CASE WHEN d.doc_id IS NULL THEN 'Document no longer exists' END AS error
  FROM orders LEFT JOIN documents d ON d.doc_id = o_custkey * 3 WHERE o_orderstatus = 'P'""")
def job_documents(spark, read):
    table = read("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 3).alias("doc_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("pending").alias("status"))
    return lifecycle.with_documents(table, read("documents"), ["lang"]).select("id", "status", "lang", "error")


@query(r"""SELECT doc_id, generate_subscripts(b, 1) - 1 AS block, unnest(b) AS text FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b FROM (SELECT doc_id, regexp_replace(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '^\s+|\s+$', '', 'g') AS text FROM documents)) WHERE len(b) > 0""")
def text_blocks(spark, read):
    """Paragraphs of every text, a blank line set after each sentence."""
    pages = read("documents").select("doc_id", F.lit(1).alias("page"), F.replace("text", F.lit(". "), F.lit(".\n \n")).alias("text"))
    return lifecycle.page_blocks(pages).select("doc_id", F.col("block").cast("long").alias("block"), "text")


@query("""SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber % 2 + 1) AS pages, list_sort(list_filter(list_distinct(list(['EMAIL', 'PERSON', 'IIN', 'DATE'][l_linenumber % 4 + 1])), lambda c: c IN ('EMAIL', 'IIN', 'ORG'))) AS categories FROM lineitem GROUP BY l_orderkey""")
def affected_pages(spark, read):
    return lifecycle.affected_pages(_boxes(read), ["EMAIL", "IIN", "ORG"])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'r' || o_orderkey || '.pdf' END AS result_filename, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS result_size FROM orders""")
def tool_job_results(spark, read):
    """A tool job for every order; every fourth is claimed, every second has a result, which counts for the claimed ones."""
    o, key = read("orders"), F.col("o_orderkey")
    text = lambda v: F.lit(v).cast("string")
    asked = o.select(key.alias("id"), F.col("o_custkey").alias("owner"), F.lit(1).alias("source_document_id"), text("compress").alias("kind"), text("a.pdf").alias("filename"), text("application/pdf").alias("content_type"), text("/in/a.pdf").alias("path"), text("{}").alias("options"))
    running = lifecycle.tool_jobs_of(asked, _now()).withColumn("status", F.when(F.col("id") % 4 == 0, "running").otherwise("pending"))
    results = o.filter("o_orderkey % 2 = 0").select(key.alias("id"), F.concat(F.lit("/out/r"), key.cast("string"), F.lit(".pdf")).alias("path"), text("application/pdf").alias("content_type"), F.col("o_custkey").alias("size"))
    return lifecycle.complete_tool_jobs(running, results, _now()).select("id", "status", "result_filename", "result_size")
