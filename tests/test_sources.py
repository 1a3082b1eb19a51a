"""Files, quotas, digests, vectors by content, checked answers and grounded chat."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern import registry_state
from lectern.functions import answers
from lectern.operators import privacy
from lectern.plans import grounded, pagewise
from lectern.sources import embedding, ingest, registration, stores


def _zip(*names):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return data.getvalue()


FILES = "path string, length long, content binary"


def test_every_reject_code_has_a_file(spark):
    rows = [("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b""), ("c.pdf", b"GIF"), ("locked.pdf", b"%PDF-locked"), ("broken.pdf", b"%PDF-broken")]
    files = spark.createDataFrame([(p, len(c), c) for p, c in rows] + [("d.pdf", ingest.MAX_BYTES + 1, b"%PDF-"), ("n.pdf", 3, None)], FILES)

    def engine(content):
        if b"broken" in content:
            raise ValueError("no pages")
        return b"locked" in content, 3

    got = {r["path"]: (r["reject_code"], r["reason"]) for r in ingest.check_pdfs(files, engine).collect()}
    assert got == {"a.pdf": (None, None), "b.pdf": (400, "empty"), "c.pdf": (415, "not_a_pdf"), "d.pdf": (413, "too_large"), "n.pdf": (415, "not_a_pdf"), "locked.pdf": (400, "pages"), "broken.pdf": (400, "pages")}
    words = [("a.docx", _zip("word/document.xml")), ("b.odt", _zip("content.xml")), ("c.doc", ingest.OLD_WORD + b"x"), ("d.txt", b"x"), ("e.docx", b""), ("f.docx", b"not a zip"), ("g.docx", _zip("other")), ("H.DOCX", _zip("word/document.xml"))]
    got = {r["path"]: (r["reject_code"], r["reason"]) for r in ingest.check_word(spark.createDataFrame([(p, len(c), c) for p, c in words], FILES)).collect()}
    assert {p for p, (c, _) in got.items() if c is None} == {"a.docx", "b.odt", "c.doc", "H.DOCX"}
    assert {p: r for p, (c, r) in got.items() if c} == {"d.txt": "extension", "e.docx": "empty", "f.docx": "not_a_document", "g.docx": "not_a_document"}


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-2"), ("c.pdf", b"GIF")):
        (tmp_path / "in" / name).write_bytes(content)
    target = f"file://{tmp_path}/out"
    ingest.ingest(spark, f"file://{tmp_path}/in", target, files_per_batch=2).awaitTermination()
    good, refused = (lambda: spark.read.parquet(f"{target}/good")), (lambda: spark.read.parquet(f"{target}/quarantine"))
    assert good().count() == 2 and [r["reason"] for r in refused().collect()] == ["not_a_pdf"]
    ingest.ingest(spark, f"file://{tmp_path}/in", target).awaitTermination()  # nothing new
    again = spark.createDataFrame([("a.pdf", 6, b"%PDF-1")], FILES).withColumn("modificationTime", F.current_timestamp())
    for _ in range(2):
        ingest.write_batch(ingest.check_pdfs(again), 7, target)
    assert good().count() == 3 and good().select("sha256").distinct().count() == 2


def test_refused_files_use_nothing_of_the_quota(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["ann", "bob", None]), rng.randrange(50), rng.choice([0, 10, 400, 900, None]), rng.choice([True, True, False, None]), rng.choice([False, False, True])) for i in range(200)]
    used, total, want = {"ann": 300, None: 100}, {}, {}
    for i, owner, _, size, flat, text in sorted(rows, key=lambda r: (r[2], r[0])):
        t = total.setdefault(owner, used.get(owner, 0))
        reason = "not_flattened" if not flat or text else "quota" if t + (size or 0) > 5000 else None
        want[i] = (reason is None, reason, t)
        total[owner] += (size or 0) if reason is None else 0
    requests = spark.createDataFrame(rows, "id long, owner string, at int, size long, flattened boolean, selectable_text boolean")
    got = registration.admit(requests, spark.createDataFrame(list(used.items()), "owner string, used long"), 5000)
    assert {r["id"]: (r["admitted"], r["reason"], r["used_before"]) for r in got.collect()} == want
    assert got.columns == [*requests.columns, "admitted", "reason", "used_before"]


def test_artifacts_know_their_files_again(spark):
    files = spark.createDataFrame([("s", b"source"), ("m", b"made"), ("x", b"other")], "path string, content binary")
    asked = spark.createDataFrame([(1, "ann", 1, 4, True, False, "s", "m", 3), (2, "ann", 2, 4, True, False, "s", "gone", 0)], "id long, owner string, at int, size long, flattened boolean, selectable_text boolean, source_path string, stored_path string, page_count int")
    none = spark.createDataFrame([], "owner string, used long")
    made = registration.artifact_rows(registration.admit(asked, none), registration.digests(files), "p2", "d1")
    first = made.filter("artifact_id = 1").first()
    assert first["unchecked_pages"] == [1, 2, 3] and first["status"] == "verifying" and first["checked_pages"] == []
    ok = lambda f: {r["artifact_id"]: r["hash_ok"] for r in registration.with_hash_ok(made, f).collect()}
    assert ok(files) == {1: True, 2: False}
    assert ok(files.withColumn("content", F.when(F.col("path") == "s", F.lit(b"changed")).otherwise(F.col("content")))) == {1: False, 2: False}
    assert {r["owner"]: r["used"] for r in registration.stored_bytes((made, "owner", "size_bytes"), (asked, "owner", "size")).collect()} == {"ann": 16}


def _embedder():
    def vector(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t) + 1), 1.0] for t in texts]

    return vector


def test_equal_texts_are_embedded_once_and_the_oldest_go(spark):
    cache = spark.createDataFrame([], embedding.CACHE)
    texts = lambda names: spark.createDataFrame(list(enumerate(names)), "place long, text string")
    first, cache = embedding.with_embeddings(texts(["a", "bb", "a", None, "bad"]).coalesce(1), cache, _embedder(), "m", 1, keep=3)
    assert all(r["error"] for r in first.filter("text = 'bad'").collect())
    one = lambda n, c, now, keep=3: embedding.with_embeddings(texts(n), c, _embedder(), "m", now, keep)
    _, cache = one(["a", "bb", "a", ""], spark.createDataFrame([], embedding.CACHE), 1)
    assert cache.count() == 3
    second, cache = one(["a", "new"], cache, 2)
    assert {r["text"]: r["cached"] for r in second.collect()} == {"a": True, "new": False}
    third, _ = one(["a", "new", "bb", ""], cache, 3)
    assert {r["text"]: r["cached"] for r in third.collect()} == {"a": True, "new": True, "bb": False, "": True}  # "bb" was the oldest
    assert embedding.problem_of([[1.0], [0.0]], 2) and embedding.problem_of([[1.0]], 2) and embedding.problem_of([[1.0], [1.0, 2.0]], 2) and not embedding.problem_of([[1.0], [2]], 2)


def _plain(value, rule, path="$"):
    """The same check over parsed JSON, by recursion."""
    kind = rule["kind"]
    if value is None:
        return [] if rule.get("nullable") else [f"{path}: null"]
    number = lambda v: v if isinstance(v, (int, float)) and not isinstance(v, bool) else float(v) if isinstance(v, str) and v.replace(".", "", 1).isdigit() else None
    if kind == "object":
        if not isinstance(value, dict):
            return [f"{path}: not_object"]
        out = []
        for name, inner in rule["fields"].items():
            out += _plain(value[name], inner, f"{path}.{name}") if name in value else [] if inner.get("optional") else [f"{path}.{name}: missing"]
        return out + [f"{path}.{n}: extra" for n in sorted(set(value) - set(rule["fields"]))] * bool(rule.get("closed"))
    if kind == "array":
        if not isinstance(value, list):
            return [f"{path}: not_array"]
        out = [f"{path}: too_long"] if len(value) > rule.get("most", 10**9) else []
        return out + [w for i, v in enumerate(value) for w in _plain(v, rule["items"], f"{path}[{i}]")]
    if kind == "string":
        if not isinstance(value, str):
            return [f"{path}: not_string"]
        rules = {"too_short": len(value) < rule.get("least", 0), "too_long": len(value) > rule.get("most", 10**9), "not_allowed": "among" in rule and value not in rule["among"]}
        return [f"{path}: {k}" for k, broken in rules.items() if broken]
    if kind == "boolean":
        return [] if isinstance(value, bool) or value in ("true", "false") else [f"{path}: not_boolean"]
    n = number(value)
    if n is None or (kind == "integer" and n != int(n)):
        return [f"{path}: not_{kind}"]
    return [f"{path}: too_small"] * ("from" in rule and n < rule["from"]) + [f"{path}: too_large"] * ("to" in rule and n > rule["to"])


def test_answers_equal_a_plain_validator(spark):
    finding = {"category": "style", "severity": "low", "page": 1, "evidence": "e", "explanation": "x", "confidence": 0.5, "basis": "ocr"}
    good = {"task": "summary", "overview": "o", "coverage": {}, "findings": [finding], "key_points": [{"text": "t", "page": None}]}
    rng, cases = random.Random(2), [good, {}, [], "text", 5, None, good | {"findings": {}}, good | {"coverage": None}, good | {"unknown": 1}]
    odd = [None, "", "x" * 5000, -1, 0, 1, 1.5, True, [], {}, "7", "style", [None], ["a"]]
    for _ in range(120):
        f = dict(finding)
        for k in rng.sample(sorted(f), rng.randrange(4)):
            f[k] = rng.choice(odd)
        for k in rng.sample(sorted(f), rng.randrange(2)):
            del f[k]
        c = good | {"findings": [f, finding] * rng.choice([1, 1, 60])}
        if rng.random() < 0.5:
            c[rng.choice(["overview", "verdict", "key_points", "coverage", "task"])] = rng.choice(odd)
        cases.append(c)
    texts = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["w"] for r in texts.select("i", answers.violations(F.col("t"), answers.ANALYSIS).alias("w")).collect()}
    assert all(got[i] == _plain(c, answers.ANALYSIS) for i, c in enumerate(cases))
    closed = {"kind": "object", "fields": {"a": {"kind": "boolean"}}, "closed": True}
    more = spark.createDataFrame([('{"a": true, "z": 1, "b": 2}',), ("not json",), (None,)], "t string").select(answers.violations(F.col("t"), closed).alias("w"))
    assert [r["w"] for r in more.collect()] == [["$.b: extra", "$.z: extra"], ["$: not_json"], ["$: not_json"]]


def test_grounded_answers_are_checked_and_merged(spark):
    texts = {0: "Total is 42 tenge. " + "a" * 4000, 1: "Paid on Monday. " + "b" * 4000, 2: "Nothing here."}
    rows = [(1, 10, i, i + 1, t, "native", "high", None, 0, 5) for i, t in texts.items()] + [(1, 11, 0, None, "Only 7 words", "ocr", "low", 70.0, 0, 1), (2, 11, 0, None, "Only 7 words", "ocr", "low", 70.0, 0, 1)]
    contexts = spark.createDataFrame(rows, "question_id long, doc_id long, chunk_index int, page_number int, text string, extraction_method string, extraction_quality string, confidence double, uncertain_region_count int, total_chunks int")
    questions = spark.createDataFrame([(1, "how much"), (2, "bad")], "question_id long, question string")

    def answer(observation, chunk, quote, **more):
        return json.dumps({"conclusions": [{"observation": observation, "citations": [{"chunk_index": chunk, "quote": quote}], **more}], "limitations": ["part only"]})

    def generate(question, excerpts):
        first, second = answer("It is 42", 0, "Total  is 42"), answer("It was 43 on Monday", 1, "Paid on Monday", suggestion="Check it")
        return F.when(question == "bad", '{"conclusions": 5}').when(excerpts.contains("Total"), first).when(excerpts.contains("Monday"), second).otherwise('{"conclusions": []}')

    got = {(r["question_id"], r["doc_id"]): r for r in grounded.grounded_answers(contexts, questions, generate).collect()}
    one = got[1, 10]
    assert one["answer"] == (
        "Наблюдение: It is 42\nОснование (стр. 1, цитата найдена): «Total  is 42»\n\n"
        "Требует проверки: It was 43 on Monday\nОснование (стр. 2, цитата найдена): «Paid on Monday»\nРекомендация системы: Check it\n\n"
        f"Ограничения: part only {grounded.IN_PARTS} {grounded.SELECTED}"
    )
    assert one["pages_reviewed"] == [1, 2, 3] and one["truncated_context"] and one["n_conclusions"] == 2 and one["error"] is None
    assert got[1, 11]["answer"] == grounded.NOTHING_FOUND and got[1, 11]["limitations"] == []
    assert got[2, 11]["answer"] is None and got[2, 11]["error"] == "$.conclusions: not_array"


def test_every_pattern_is_found_alone_in_its_group():
    for line, value, category, confidence, review in registry_state.PLANTED:
        group = privacy.TAXONOMY[category][0]
        for groups in ([group], privacy.TEXT_GROUPS):
            spans = privacy.detect_text(line, groups=groups)[0]
            assert (value, category, confidence, review) in [(line[s["start"] : s["end"]], s["category"], s["confidence"], s["review_required"]) for s in spans]
    assert {c for c, *_ in privacy.PATTERNS} - {"IIN_OR_BIN", "BARE_ID"} <= {p[2] for p in registry_state.PLANTED}


@pytest.mark.parametrize("most", [10, 6500])
def test_excerpts_fill_batches_in_order(spark, most):
    rows = [(1, i, None, "x" * n, "native", "high", None, 0) for i, n in enumerate([4, 4, 4, 20, 1, 1])]
    df = spark.createDataFrame(rows, "key long, chunk_index int, page_number int, text string, extraction_method string, extraction_quality string, confidence double, uncertain_region_count int")
    got = {r["batch"]: r["excerpts"].count("[chunk") for r in grounded.excerpt_batches(df, most).collect()}
    assert got == ({0: 2, 1: 1, 2: 1, 3: 2} if most == 10 else {0: 6})


def test_pages_are_analyzed_checked_and_merged(spark):
    pages = spark.createDataFrame([(1, 1, "Total is 42. " * 3), (1, 2, " "), (1, 3, "word " * 2500), (2, 1, None), (3, 1, "bad"), (4, 1, "other page")], "doc_id long, page int, text string")
    finding = {"category": "logic", "severity": "low", "evidence": "Total  is 42", "explanation": "x", "confidence": 0.5, "basis": "native_text"}

    def generate(page, text):
        point = F.concat(F.lit('{"text": "p", "evidence": "word", "page": '), page.cast("string"), F.lit("}"))
        many = F.concat(F.lit("["), F.array_join(F.array_repeat(point, 9), ","), F.lit("]"))
        found = F.concat(F.lit("["), F.array_join(F.array(*[F.concat(F.lit(json.dumps(f)[:-1] + ', "page": '), page.cast("string"), F.lit("}")) for f in (finding, finding | {"basis": "vision"})]), ","), F.lit("]"))
        whole = F.concat(F.lit('{"task": "summary", "overview": "seen", "coverage": {}, "key_points": '), many, F.lit(', "findings": '), found, F.lit("}"))
        return F.when(text == "bad", "{}").when(text == "other page", F.regexp_replace(whole, '"page": 1', '"page": 7')).otherwise(whole)

    got = {r["doc_id"]: r for r in pagewise.analyze_pages(pages, "summary", generate).collect()}
    one = got[1]
    assert one["error"] is None and one["pages_reviewed"] == [1, 3] and not one["complete"]
    assert one["overview"].split("\n") == ["Стр. 1: seen"] + ["Стр. 3: seen"] * 3
    assert [p["page"] for p in one["key_points"]] == [1] * 9 + [3] * 11 and one["key_points"][0]["evidence_verified"] is False and one["key_points"][9]["evidence_verified"]
    assert [(f["basis"], f["evidence_verified"], f["requires_human_review"]) for f in one["findings"][:3]] == [("ocr", True, False), ("vision", False, True), ("ocr", False, True)] and len(one["findings"]) == 8
    assert one["limitations"] == [pagewise.UNREADABLE.format(2), pagewise.PARTLY, pagewise.CUT, pagewise.BY_PAGE]
    assert got[2]["error"] == "no readable pages" and got[2]["overview"] is None
    assert "$.overview: missing" in got[3]["error"] and got[4]["error"] == "cited a page that was not given"


def test_each_page_falls_back_alone(spark):
    def text(content, i):
        part = content.split(b"|")[i]
        if part == b"!":
            raise ValueError("broken page")
        return part.decode()

    def count(content):
        if content == b"#":
            raise ValueError("no file")
        return len(content.split(b"|"))

    engines = [(count, text), (count, lambda c, i: "" if i == 2 else f"ocr {i}")]
    files = spark.createDataFrame([("a", b"one|!| |four"), ("b", b"#")], "path string, content binary")
    got = sorted(((r["path"], r["page_number"], r["text"], r["engine"], r["error"]) for r in stores.read_pages(files, engines).collect()), key=str)
    assert got == [("a", 1, "one", 0, None), ("a", 2, "ocr 1", 1, None), ("a", 3, " ", 0, None), ("a", 4, "four", 0, None), ("b", None, None, None, "ValueError: no file")]


def test_chunks_go_with_swept_documents(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in stores.sweep_chunks(chunks, docs, docs.filter("doc_id <> 2")).collect()) == [1, 9]


def test_copies_are_stored_with_their_times(spark):
    from lectern.operators import lifecycle

    schema = "id long, retention string, remote_name string, remote_uri string, remote_expires_at int, remote_started_at int, cleanup_status string, cleanup_error string"
    jobs = spark.createDataFrame([(1, "retain_48h", None, None, None, None, None, None), (2, "delete", "a", "u", 5, 1, "failed", "x"), (3, "delete", "b", "u", 5, 1, None, "x")], schema)
    copies = spark.createDataFrame([(1, "n", "v", 9), (2, "a", "v", 9)], "id long, name string, uri string, expires_at int")
    got = {r["id"]: tuple(r)[2:] for r in lifecycle.store_copies(jobs, copies, F.lit(7)).collect()}
    assert got == {1: ("n", "v", 9, 7, "retained", None), 2: ("a", "v", 9, 1, "pending", None), 3: ("b", "u", 5, 1, None, "x")}
    asked = spark.createDataFrame([("local", None, None), ("external", None, True), ("review", True, False), ("external", True, True), (None, True, True)], "m string, c boolean, a boolean")
    assert [r[0] for r in asked.select(lifecycle.asked_consent(F.col("m"), F.col("c"), F.col("a"))).collect()] == [None, "consent_required", "terms_not_acknowledged", None, None]
