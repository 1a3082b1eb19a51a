"""Cases of detection, masking, layout, review, queue, artifacts and stores with results known beforehand."""

from __future__ import annotations

import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, findings, jobs, layout, privacy, retrieval, review
from lectern.plans import pipelines
from lectern.sources import stores
from lectern.streaming import machines


def spans_of(text, **options):
    return [(s["category"], text[s["start"] : s["end"]], s["confidence"], s["review_required"]) for s in privacy.detect_text(text, **options)[0]]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_addresses_end_before_contacts_and_companies():
    assert spans_of("Адрес: г. Алматы, ул. Абая, д. 5, ТОО «Ромашка»")[0][:2] == ("ADDRESS", "г. Алматы, ул. Абая, д. 5")
    assert [s[0] for s in spans_of("Юридический адрес: info@x.kz")] == ["EMAIL"]
    assert spans_of("г. Астана, проспект Мәңгілік Ел, 55")[0][0] == "ADDRESS"


def test_organisations_of_every_form():
    texts = ["ТОО «Альфа»", "«Бета» ЖШС", "акционерное общество «Гамма»", "Министерство юстиции Республики Казахстан", "акимат города Алматы", "Қазақстан Республикасының Әділет министрлігі", "Алматы қаласының әкімдігі"]
    assert [[s[0] for s in spans_of(t)] for t in texts] == [["ORG"]] * 7


def test_financial_spans_and_their_review():
    text = "KZ86125KZT5004100100, KZ00125KZT5004100100, 4111 1111 1111 1111, 5 000 ₸ карта 4111 1111 1111 1112"
    assert spans_of(text) == [
        ("IBAN", "KZ86125KZT5004100100", 0.99, False), ("IBAN", "KZ00125KZT5004100100", 0.72, True), ("PAYMENT_CARD", "4111 1111 1111 1111", 0.98, False),
        ("AMOUNT", "5 000 ₸", 0.95, False), ("PAYMENT_CARD", "4111 1111 1111 1112", 0.70, True),
    ]
    assert [s[1] for s in spans_of("x5 000 руб, 250 € и 99 USD, 7,50 тенге")] == ["000 руб", "250 €", "99 USD", "7,50 тенге"]


def test_an_identifier_suppresses_what_else_its_digits_look_like():
    assert [s[0] for s in spans_of("БИН 870112345678")] == ["BIN"]


def test_failures_are_told_or_raised():
    def broken(text):
        raise ValueError("x" * 500)

    spans, failures = privacy.detect_text("a@b.kz", {"names": broken, "place": lambda t: [(0, 1, "LOCATION", 0.9)]})
    assert [s["category"] for s in spans] == ["EMAIL"] and failures == [{"detector": "names", "message": "x" * 240}]
    with pytest.raises(privacy.DetectionIncomplete):
        privacy.detect_text("a", {"names": broken}, fail_closed=True)


def test_disjoint_choice_equals_the_quadratic_one():
    import random

    rng = random.Random(3)
    for _ in range(200):
        rows = [privacy._span(a := rng.randrange(40), a + rng.randrange(1, 9), rng.choice(["ORG", "PERSON", "DATE"]), rng.choice([0.8, 0.9]), rng.choice([60, 70]), "x") for _ in range(12)]
        kept = []
        for s in sorted(rows, key=lambda s: (-s["priority"], -s["confidence"], s["start"] - s["end"], s["start"], s["category"])):
            if all(s["end"] <= k["start"] or k["end"] <= s["start"] for k in kept):
                kept.append(s)
        assert privacy.disjoint(rows, 100) == sorted(kept, key=lambda s: s["start"])


def test_masking_is_stable_over_a_session_and_restores():
    texts = ["Пишите a@b.kz или A@B.kz", "снова a@b.kz, тел 87011234567"]
    masked, values = privacy.mask_spans(texts, [privacy.detect_text(t)[0] for t in texts])
    assert masked == ["Пишите [EMAIL_1] или [EMAIL_1]", "снова [EMAIL_1], тел [PHONE_1]"] and values == {"[EMAIL_1]": "a@b.kz", "[PHONE_1]": "87011234567"}


def test_restore_refuses_unknown_placeholders(spark):
    tokens = F.create_map(F.lit("[PERSON_1]"), F.lit("Ann"), F.lit("[PERSON_11]"), F.lit("Bob"))
    assert one(spark, t=privacy.restore_tokens(F.lit("[PERSON_11] and [PERSON_1] [x]"), tokens))["t"] == "Bob and Ann [x]"
    for bad in ("[PERSON_999]", "[person-1]"):
        with pytest.raises(Exception, match="unknown privacy placeholder"):
            one(spark, t=privacy.restore_tokens(F.lit(bad), tokens))


def test_documents_are_masked_with_all_their_spans(spark):
    rows = [(1, "a@b.kz и 5 000 ₸, a@b.kz"), (2, None), (3, "")]
    got = privacy.mask_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    back = got.select("doc_id", "masked", "entity_count", "categories", privacy.restore_tokens(F.col("masked"), F.col("tokens")).alias("r")).orderBy("doc_id").collect()
    assert [tuple(r) for r in back] == [(1, "[EMAIL_1] и [AMOUNT_1], [EMAIL_1]", 2, {"AMOUNT": 1, "EMAIL": 1}, rows[0][1]), (2, "", 0, {}, ""), (3, "", 0, {}, "")]


def test_chunks_are_cut_after_a_strip():
    assert [len(c) for c in chunking.cut("\n" * 40 + "word " * 700)] == [1599, 1594, 604]
    assert chunking.cut("") == [] and chunking.cut(" \n") == [] and chunking.cut("x" * 1600) == ["x" * 1600]


def test_pieces_and_batches():
    heads = ["[chunk=7; страница 1; extraction=ocr; quality=low; confidence=80.0]", "[chunk=7; страница 1; extraction=ocr; quality=low; continued]", "[chunk=7]"]
    parts = review.under_heads(heads, "слово " * 400, 300)
    assert len(parts) > 5 and all(p.startswith("[chunk=7") and len(p) <= 300 for p in parts) and "continued" in parts[1]
    assert " ".join(p.partition("\n")[2] for p in parts).split() == ["слово"] * 400
    assert review.fill_batches(["a" * 5, "b" * 3, "c" * 4], 10) == ["aaaaa\n\nbbb", "cccc"]
    assert review.split_with_placeholders("aaa bbb [PERSON_1] ccc", 12) == ["aaa bbb", "[PERSON_1]", "ccc"]
    with pytest.raises(ValueError):
        review.split_with_placeholders("[PERSON_123456789]", 8)
    assert review.under_heads(heads, "a " * 40, 40)[1].startswith("[chunk=7]\n") and review.under_heads(heads, "short", 300) == [heads[0] + "\nshort"]
    with pytest.raises(ValueError):
        review.under_heads(heads, "a " * 40, 10)
    for text in ("x [A_1] y", "[[A] b] c", "no [open end " * 9, "a] b [c " * 9):
        for most in (8, 13, 20):
            want = _cut_by_scanning(text, most)
            if want is None:
                with pytest.raises(ValueError):
                    review.split_with_placeholders(text, most)
            else:
                assert review.split_with_placeholders(text, most) == want


def _cut_by_scanning(text, most):
    out = []
    while len(text) > most:
        part = text[:most]
        if part.rfind("[") > part.rfind("]"):
            part = part[: part.rfind("[")]
        at = max(part.rfind(" "), part.rfind("\n"))
        part = part[:at] if at >= max(len(part) // 2, 1) else part
        if not part:
            return None
        out.append(part.strip())
        text = text[len(part) :].strip()
    return [*out, text] if text else out


@pytest.mark.parametrize("most", [0, 5, 40, 47, 60, 5000])
def test_representative_contexts_fit(spark, most):
    for n in (1, 2, 3, 10, 23):
        contexts = [chr(97 + i) * (5 + 7 * i % 19) for i in range(n)]
        got = one(spark, r=review.representative(F.array(*map(F.lit, contexts)), most))["r"]
        want = contexts
        if most <= 0:
            want = []
        elif len("\n\n".join(contexts)) > most:
            k = max(1, min(n, most // max(sum(map(len, contexts)) // n, 1)))
            want = [contexts[0][:most]] if k == 1 else [contexts[i] for i in dict.fromkeys(round(i * (n - 1) / (k - 1)) for i in range(k))]
            while k > 1 and len(want) > 1 and len("\n\n".join(want)) > most:
                want = [*want[:-2], want[-1]]
        assert got == want


def _chunks(spark, texts, **more):
    rows = [(1, i, 1, t, "native", "high", None, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, chunk_index int, page_number int, text string, extraction_method string, extraction_quality string, confidence double, uncertain_region_count int")


def test_reviews(spark):
    shared = "a shared boundary of thirty two c"
    chunks = _chunks(spark, ["first " + shared, shared + " second", "  "])
    q = review.quick_review(chunks).first()
    assert q["prompt"].count(shared) == 1 and q["complete"] and q["prompt"].startswith("[chunk=0; страница 1; extraction=native; quality=high; confidence=n/a; uncertain_regions=0]\n")
    assert review.review(chunks, "quick", F.upper).first()["batch_count"] == 1
    large = _chunks(spark, ["w" * 9000 + str(i) for i in range(8)])
    assert review.thorough_review(large).first()["too_large"]
    with pytest.raises(Exception, match="too many review batches"):
        review.review(large, "thorough", F.upper).collect()
    with pytest.raises(ValueError, match="no review mode"):
        review.review(chunks, "other", F.upper)


def test_evidence_on_pages(spark):
    pages = spark.createDataFrame([(1, 1, "Total  is\n42 tenge"), (1, 2, " ")], "doc_id long, page int, text string")
    rows = [(1, "a", 1, "Total is 42", "text", False), (1, "b", 1, "Total is 43", "ocr", False), (1, "c", 2, "x", "ocr", False), (1, "d", 1, "Total is 42", "vision", False), (1, "e", 3, "x", "ocr", False)]
    got = {r["id"]: (r["evidence_verified"], r["requires_human_review"], r["basis"], r["error"]) for r in review.verify_evidence(spark.createDataFrame(rows, "doc_id long, id string, page int, evidence string, basis string, requires_human_review boolean"), pages).collect()}
    assert got == {"a": (True, False, "ocr", None), "b": (False, True, "ocr", None), "c": (False, True, "ocr", None), "d": (False, True, "vision", None), "e": (False, True, "ocr", "invalid page")}
    results = [(1, "summary", [1, 2], True), (1, "layout_review", [1, 2], True), (1, "risk", [1, 1], False), (1, "risk", [3], False), (1, "risk", [1], True)]
    told = review.verify_coverage(spark.createDataFrame(results, "doc_id long, task string, pages_reviewed array<int>, complete boolean"), pages).collect()
    assert sorted((r["task"], tuple(r["pages_reviewed"]), r["complete"], r["error"], tuple(r["unread_pages"])) for r in told) == sorted([("summary", (1, 2), False, None, (2,)), ("layout_review", (1, 2), True, None, (2,)), ("risk", (1, 1), False, "duplicate coverage pages", (2,)), ("risk", (3,), False, "invalid coverage page", (2,)), ("risk", (1,), False, "incomplete page coverage", (2,))], key=str) or len(told) == 5


def test_answers_have_a_line_for_each_citation(spark):
    c = spark.createDataFrame([(1, 1, "It costs 5", "ask again", True), (1, 2, "It is red", None, False)], "question_id int, conclusion_id int, observation string, suggestion string, requires_review boolean")
    t = spark.createDataFrame([(1, 0, "costs 5", 2, 7, False), (2, 0, "red", None, 8, True)], "conclusion_id int, place int, quote string, page int, chunk_index int, text_matched boolean")
    r = review.answers(c, t).first()
    assert r["answer"] == "Требует проверки: It costs 5\nОснование (стр. 2, цитата не подтверждена): «costs 5»\nРекомендация системы: ask again\n\nНаблюдение: It is red\nОснование (фрагмент 8, цитата найдена): «red»" and r["pages_reviewed"] == [2]


def test_map_reduce_generates_each_text_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def half(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.str[: 3000]

    chunks = spark.createDataFrame([(1, i, "x" * 5000) for i in range(6)] + [(2, 0, "y")], "doc_id long, chunk_index int, text string")
    got = {r["doc_id"]: len(r["answer"]) for r in pipelines.map_reduce(chunks, half).collect()}
    assert got == {1: 3000, 2: 1} and calls.value == 7 + 2 + 1


def test_hybrid_context_needs_vectors(spark):
    chunks = _chunks(spark, [f"word{i} common" for i in range(8)])
    questions = spark.createDataFrame([(1, "word3")], "question_id int, question string")
    plain = pipelines.ask_hybrid(chunks, questions, None, None, 2).collect()
    assert {r["note"] for r in plain} == {"vector search unavailable"} and 3 in {r["chunk_index"] for r in plain}
    vectors = spark.createDataFrame([(1, i, [float(i == 6), float(i == 3), 0.1]) for i in range(8)], "doc_id long, chunk_index int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "question_id int, embedding array<double>")
    got = pipelines.ask_hybrid(chunks, questions, vectors, asked, 2).collect()
    assert {r["method"] for r in got} == {"hybrid"} and {3, 6} >= {r["chunk_index"] for r in got} and len(got) == 2


def test_canonical_json_is_that_of_the_standard_library(spark):
    parts = {"user_id": 7, "task": "Итог 🙂 \"q\"\\", "model": None, "artifact_id": 3}
    want = json.dumps(parts, ensure_ascii=True, separators=(",", ":"), sort_keys=True)
    columns = {k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in parts.items()}
    r = one(spark, j=jobs.canonical_json(**columns), k=jobs.dedupe_key(**columns))
    assert r["j"] == want and r["k"] == hashlib.sha256(want.encode()).hexdigest()


def test_machines_allow_what_they_list(spark):
    for name, table in jobs.MACHINES.items():
        states = spark.createDataFrame([(s, e) for s, _ in table for _, e in table], "s string, e string").distinct()
        for r in states.select("s", "e", jobs.advance(F.col("s"), F.col("e"), name).alias("t")).collect():
            assert r["t"] == table.get((r["s"], r["e"]))


def test_boxes_on_each_other_are_one_finding(spark):
    rows = [(1, "a", 1, "PERSON", 0.9, 0.0, 0.0, 10.0, 10.0), (1, "b", 1, "IIN", 0.8, 1.0, 1.0, 10.0, 10.0), (1, "c", 1, "DATE", 0.9, 8.0, 8.0, 20.0, 20.0), (1, "d", 2, "DATE", 0.9, 0.0, 0.0, 10.0, 10.0)]
    f = spark.createDataFrame(rows, "doc_id long, id string, page int, category string, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["id"] for r in findings.drop_same_boxes(f).collect()) == ["b", "c", "d"]
    r = one(spark, **findings.percent_to_points(F.lit(50.0), F.lit(-1.0), F.lit(60.0), F.lit(10.0), F.lit(600.0), F.lit(800.0)))
    assert (r["x0"], r["y0"], r["x1"], r["y1"]) == (300.0, 0.0, 600.0, 72.0)
    r = one(spark, o=findings.page_needs_ocr(F.lit(40), F.array(F.lit(5.0)), F.lit(1000.0)), s=findings.is_full_page_scan(F.array(F.lit(800.0)), F.lit(1000.0)))
    assert not r["o"] and r["s"]


def test_areas_without_a_finding_are_manual(spark):
    a = spark.createDataFrame([(1, "f"), (1, "g")], "doc_id long, id string")
    f = spark.createDataFrame([(1, "f", "IIN", "personal")], "doc_id long, id string, category string, group string")
    assert sorted((r["id"], r["category"]) for r in findings.chosen_areas(a, f).collect()) == [("f", "IIN"), ("g", "MANUAL")]


WORDS = "page_id long, word_id long, text string, confidence double, left int, top int, width int, height int, block int, paragraph int, line int"


def _words(spark, rows):
    return spark.createDataFrame([(1, i, t, c, left, top, 8, 8, 0, 0, line) for i, (t, c, left, top, line) in enumerate(rows)], WORDS)


def test_lines_go_by_place_and_not_by_number(spark):
    words = _words(spark, [("b", 90.0, 20, 30, 1), ("a", 90.0, 0, 30, 1), ("top", 90.0, 0, 0, 2)])
    assert layout.assemble_lines(words).first()["text"] == "top\na b"


def test_spans_worth_a_second_reading(spark):
    words = _words(spark, [("ТОО", 90.0, 0, 0, 1), ("«Aль", 50.0, 10, 0, 1), ("фа»", 60.0, 20, 0, 1), ("АРІ", 90.0, 0, 9, 2), ("cлово", 90.0, 9, 9, 2), ("wh?t", 90.0, 18, 9, 2), ("Оценка:", 90.0, 0, 18, 3), ("4,5", 70.0, 9, 18, 3)])
    got = sorted((r["reason"], r["words"]) for r in layout.retry_spans(words).collect())
    assert got == [("mixed_script", [4]), ("organization", [1, 2]), ("placeholder", [5]), ("protected_term", [3])]
    assert [tuple(r) for r in layout.numeric_values(words).collect()] == [(1, 7)]
    assert layout.merged_box(words.filter("word_id in (1, 2)"), ["page_id"]).first()[1:] == (0, 0, 40, 20)
    r = one(spark, a=layout.accept_latin(F.lit("mixed_script"), F.lit("x"), F.lit("x"), F.lit(85.0), F.lit(80.0)), b=layout.accept_numeric(F.lit("4,5"), F.lit(70.0), F.lit(65.0)), c=layout.similarity(F.lit("A  b"), F.lit("a b")), g=layout.projection_groups(F.array(*map(F.lit, (1, 2, 4, 9, 10)))))
    assert (r["a"], r["b"], r["c"], r["g"]) == (True, False, 1.0, [2, 10])


def test_tables_take_their_words_and_pages_are_composed(spark):
    words = _words(spark, [("above", 90.0, 0, 0, 1), ("in", 90.0, 10, 20, 2), ("both", 90.0, 46, 20, 2), ("below", 90.0, 0, 60, 3)])
    tables = spark.createDataFrame([(1, 5, 0, 0, 15, 100, 40, "| T |")], "page_id long, table_id long, place int, left int, top int, right int, bottom int, text string")
    cells = spark.createDataFrame([(1, 5, 1, 0, 15, 50, 40), (1, 5, 2, 50, 15, 100, 40)], "page_id long, table_id long, cell_id long, left int, top int, right int, bottom int")
    placed, unclear = layout.words_in_tables(words, tables, cells)
    assert [tuple(r) for r in placed.collect()] == [(1, 5, 1)] and [tuple(r) for r in unclear.collect()] == [(5,)]
    assert layout.compose_pages(words, tables).first()["text"] == "above\n| T |\nbelow"
    span = spark.createDataFrame([(1, 0, 5)], "doc_id long, start int, end int")
    boxes = spark.createDataFrame([(1, 0, 3, 1.0, 2.0, 5.0, 6.0), (1, 4, 8, 7.0, 2.0, 9.0, 6.0), (1, 9, 10, 0.0, 0.0, 1.0, 1.0)], "doc_id long, start int, end int, x0 double, y0 double, x1 double, y1 double")
    assert layout.span_boxes(span, boxes).first()[3:] == (-0.5, 0.5, 10.5, 7.5)


def test_names_types_and_messages(spark):
    L = F.lit
    r = one(
        spark, a=T.clean_filename(L("c:\\x\\Отчёт 1.pdf")), b=T.clean_filename(L("x" * 300 + ".pdf")), c=T.clean_filename(L("a/..")), d=T.content_type(L("A.PDF"), L("application/pdf; x=1")), e=T.content_type(L("a.pdf"), L("text/plain")),
        f=T.result_name(L("Мой отчёт (1).pdf"), L("redacted"), L(7)), g=T.stored_path(L("x/y"), "store"), h=T.language_codes(L("rus, eng+kaz,")), i=T.detector_languages(L(" RU,kk,ru ")), j=T.ocr_error_kind(L("Error opening data file x")),
        k=T.ocr_error_kind(L("tesseract is not installed")), l=T.retry_after(L("{'retryDelay': '37.5s'}")), m=T.retry_after(L("later")), n=T.user_name(L("  Ann ")), o=T.user_name(L("x" * 101)), p=T.joined_pages(F.array(L(" a "), L(" "), L("b"))),
        q=T.disguised_term(L("АРІ")), s=T.single_latin_core(L("«Alfa-2»")), t=T.with_outer_punctuation(L("«Альфа»,"), L("Alfa")), u=T.format_number(L(2.50)), v=T.ai_state([L(None)], [L("done")]), w=T.format_bytes(L(0)),
        x=T.language_list(F.create_map(L("en"), L(0.25), L("de"), L(0.75))), y=T.valid_message(L("  hi "), 4), z=T.points_to_mm(L(595.0)),
    )
    assert r.asDict() == {
        "a": "Отчёт 1.pdf", "b": "x" * 251 + ".pdf", "c": None, "d": "application/pdf", "e": None, "f": "Мой-отчёт-1-redacted-7", "g": "store/x/y", "h": ["rus", "eng", "kaz"], "i": ["ru", "kk"], "j": "missing_language",
        "k": "not_installed", "l": 37, "m": None, "n": "ann", "o": None, "p": "a\n\nb", "q": "API", "s": "Alfa-2", "t": "«Alfa»,", "u": "2.5", "v": "ready", "w": "0 B", "x": "de 75%, en 25%", "y": None, "z": 209.9,
    }
    assert T.without_keys({"title": "x", "items": [{"minimum": 1, "enum": ["a"]}]}) == {"items": [{"enum": ["a"]}]}


def test_files_are_checked_and_read_by_the_first_engine_that_can(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"0")), ("c", bytearray(b"99")), ("d", bytearray(b"x")), ("e", bytearray(b"-1"))], "path string, content binary")
    got = {r["path"]: (r["page_count"], r["reject_code"]) for r in stores.reject_pages(files, lambda b: (int(b) < 0, abs(int(b)))).collect()}
    assert got == {"a": (1, None), "b": (0, 400), "c": (99, 413), "d": (None, 400), "e": (1, 400)}

    def first(content):
        if content == b"x":
            raise ValueError("broken")
        return [" "] if content == b"0" else ["first"]

    pages = {r["path"]: r["text"] for r in stores.read_with_fallback(files, [first, lambda b: ["second"]]).collect()}
    assert pages == {"a": "first", "b": "second", "c": "first", "d": "second", "e": "first"}


def test_stores(spark):
    docs = spark.createDataFrame([(1, "old", "sum"), (2, "keep", "sum")], "doc_id long, text string, ai_summary string")
    chunks = spark.createDataFrame([(1, 0, "old"), (2, 0, "keep")], "doc_id long, chunk_index int, text string")
    d, c = stores.overwrite_texts(docs, chunks, spark.createDataFrame([(1, "new")], "doc_id long, text string"), lambda x: x.withColumn("chunk_index", F.lit(0)))
    assert sorted(map(tuple, d.collect())) == [(1, "new", None), (2, "keep", "sum")] and sorted(map(tuple, c.collect())) == [(1, 0, "new"), (2, 0, "keep")]
    assert stores.claim_ownerless(spark.createDataFrame([(None,), ("a",)], "owner string"), "b")[1] == 1
    assert stores.seed_if_empty(docs.limit(0), (9, "demo", None)).first()["doc_id"] == 9 and stores.seed_if_empty(docs, (9, "demo", None)).count() == 2
    assert sorted(r[0] or "" for r in stores.detach_session(spark.createDataFrame([("s",), ("t",)], "session_id string"), "s").collect()) == ["", "t"]
    updated = stores.partial_update(docs, spark.createDataFrame([(1, None, "more")], "doc_id long, text string, ai_summary string"), "doc_id", ["text", "ai_summary"])
    assert sorted(map(tuple, updated.collect())) == [(1, "old", "more"), (2, "keep", "sum")]


def test_streams_equal_their_batch_forms(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:15:00"), (3, 1, "2024-01-01 00:29:59"), (4, 2, "2024-01-01 00:00:01")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = machines.session_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "ts")
    q = stream.writeStream.format("memory").queryName("numbered").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["key"], r["session"]): r["n"] for r in spark.table("numbered").groupBy("key", "session").agg(F.count("*").alias("n")).collect()}
    assert got == {(r["user_id"], r["session"]): r["touches"] for r in jobs.sessionize(events, "user_id", "ts").collect()} == {(1, 1): 1, (1, 2): 2, (2, 1): 1}


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_selections_equal_brute_force(spark):
    rng, none = random.Random(4), lambda x: None if rng.random() < 0.1 else x
    chosen = [(rng.randrange(300), none(str(rng.randrange(4))), none(rng.randrange(1, 6)), *((None,) * 4 if rng.random() < 0.3 else (1.0, 1.0, none(rng.choice([5.0, 50.0, 99.5])), 2.0))) for _ in range(500)]
    known = [(rng.randrange(330), none(str(rng.randrange(4)))) for _ in range(700)]
    pages = [(d, 4) for d in range(290)]
    got = findings.selection_errors(spark.createDataFrame(chosen, "doc_id long, id string, page int, x double, y double, w double, h double"), spark.createDataFrame(known, "doc_id long, id string"), spark.createDataFrame(pages, "doc_id long, page_count int"))
    want = {}
    for d in {r[0] for r in chosen}:
        rows = [r for r in chosen if r[0] == d]
        boxed = [r for r in rows if r[3] is not None]
        named = [r[1] for r in boxed if r[1] is not None]
        bad = any(r[2] is None or r[5] is None or d >= 290 or r[2] > 4 or r[3] + r[5] > 100.001 or r[4] + r[6] > 100.001 for r in boxed)
        want[d] = bad or len(named) > len(set(named)) or any(r[1] is None or (d, r[1]) not in known for r in rows if r[3] is None)
    assert {r["doc_id"]: r["invalid"] for r in got.collect()} == want and set(want.values()) == {True, False}
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 1


def test_words_are_shuffled_once(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    words = session.createDataFrame([(d, i, f"w{i % 7}", 0, 0, i // 4, i % 4 * 10, i // 4 * 10, 8, 8) for d in (1, 2) for i in range(40)], "page_id long, word_id long, text string, block int, paragraph int, line int, left int, top int, width int, height int")
    assert _exchanges(layout.assemble_lines(words)) == 1
    cells = session.createDataFrame([(1, 1, 0, 0, 20, 200)], "page_id long, cell_id long, left int, top int, right int, bottom int")
    assert _exchanges(layout.words_in_cells(words, cells)) == 2 and layout.words_in_cells(words, cells).count() == 20
    placed = layout.word_offsets(words.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), (F.col("word_id") * 1500).alias("place"), "block", "line", "text"))
    assert _exchanges(placed) == 3  # words, sums of runs, runs of a page
    rows = sorted(map(tuple, placed.select("doc_id", "place", "start", "end").collect()))
    assert rows == [(d, i * 1500, 3 * i, 3 * i + 2) for d in (1, 2) for i in range(40)]
    chunks = session.createDataFrame([(1, 0, "The cat the CAT of"), (1, 1, "cat"), (1, 1, "Cat"), (2, 0, None), (2, 1, "a b")], "doc_id long, chunk_index int, text string")
    terms = retrieval.term_frequency(chunks)
    assert sorted(map(tuple, terms.collect())) == [(1, 0, "cat", 2), (1, 0, "the", 2), (1, 1, "cat", 2)]
    assert _exchanges(retrieval.document_frequency(terms)) == 1
