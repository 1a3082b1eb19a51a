"""Analysis of a document page by page: every part of a page is asked once, what it says is checked on that part, and the
answers are merged up to the limits of a result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import chunking, evidence, review
from ..session import materialise

# A part's size and overlap, and what is said of a result's limits.
PART, OVERLAP = 6000, 150
UNREADABLE, PARTLY = "Стр. {}: нет читаемого OCR-текста.", "Проверена только часть страниц документа."
CUT = "Все указанные страницы обработаны; список выводов сокращён до лимита результата."
BY_PAGE = "Постраничный анализ; согласованность между разделами требует отдельной проверки."
VERDICT = "Рекомендации являются предложениями системы. Совпадение цитаты не доказывает корректность вывода."
_POINT = "text: string, page: int, evidence: string"
_FINDING = "category: string, severity: string, page: int, evidence: string, explanation: string, suggestion: string, confidence: double, basis: string, requires_human_review: boolean"
_SHAPE = f"task string, overview string, key_points array<struct<{_POINT}>>, findings array<struct<{_FINDING}>>"


def page_parts(pages: DataFrame) -> DataFrame:
    """(doc_id, page, part, text) of pages that have text."""
    keyed = pages.select(F.struct("doc_id", "page").alias("doc_id"), "text")
    cut = chunking.chunk_documents(keyed, size=PART, overlap=OVERLAP)
    return cut.select("doc_id.doc_id", "doc_id.page", F.col("chunk_index").alias("part"), "text")


def _borne_out(quote: Column, text: Column) -> Column:
    needle = evidence.quote_form(quote)
    return F.coalesce((needle != "") & F.contains(evidence.quote_form(text), needle), F.lit(False))


def _listed(rows: DataFrame, value: Column, most: int, name: str) -> DataFrame:
    """(doc_id, ``name``: the first ``most`` values in order of page, part and place, ``name``_n: all of them)."""
    held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "part", "place", value.alias("v")))).alias("a"))
    return held.select("doc_id", F.transform(F.slice("a", 1, most), lambda x: x["v"]).alias(name), F.size("a").alias(f"{name}_n"))


def analyze_pages(pages: DataFrame, task: str, generate: Callable[[Column, Column], Column]) -> DataFrame:
    """(doc_id, overview, verdict, key_points, findings, pages_reviewed, complete, limitations, error) of (doc_id, page, text).

    ``generate(page, text)`` is a column function to a JSON text; every answer is written before anything is made of it.
    Lists are null where no part has any. Quotes are looked up in the part that the model was given; text evidence stands on OCR, what was seen in an image
    cannot be verified, and what is not verified asks for a human. A page without text is not reviewed. An answer that
    breaks its schema, has another task or cites a page that it was not given is told as the document's ``error``, as is
    a document without any readable page; such a document has no result.
    """
    told = materialise(page_parts(pages).withColumn("raw", generate(F.col("page"), F.col("text"))))
    told = told.withColumn("wrong", answers.violations(F.col("raw"), answers.ANALYSIS)).withColumn("a", F.from_json("raw", _SHAPE))
    other = F.exists(F.concat(F.coalesce(F.transform("a.key_points", lambda p: p["page"]), F.array().cast("array<int>")), F.coalesce(F.transform("a.findings", lambda f: f["page"]), F.array().cast("array<int>"))), lambda p: p != F.col("page"))
    error = F.when(F.size("wrong") > 0, F.array_join("wrong", "; ")).when(F.col("a.task") != task, "wrong task").when(F.coalesce(other, F.lit(False)), "cited a page that was not given")
    told = told.withColumn("error", error)

    found = told.select("doc_id", "page", "part", "text", F.posexplode("a.findings").alias("place", "f"))
    seen = F.col("f.basis") == "vision"
    verified = ~seen & _borne_out(F.col("f.evidence"), F.col("text"))
    finding = F.struct(
        "f.category", "f.severity", "f.page", "f.evidence", "f.explanation", F.coalesce("f.suggestion", F.lit("")).alias("suggestion"), "f.confidence", F.when(seen, "vision").otherwise("ocr").alias("basis"),
        (F.coalesce("f.requires_human_review", F.lit(False)) | ~verified).alias("requires_human_review"), verified.alias("evidence_verified"),
    )
    points = told.select("doc_id", "page", "part", "text", F.posexplode("a.key_points").alias("place", "p"))
    point = F.struct("p.text", "p.page", F.coalesce("p.evidence", F.lit("")).alias("evidence"), (F.col("p.page").isNotNull() & _borne_out(F.col("p.evidence"), F.col("text"))).alias("evidence_verified"))

    line = F.concat(F.lit("Стр. "), F.col("page").cast("string"), F.lit(": "), F.col("a.overview"))
    said = told.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "part", line.alias("line")))).alias("o"), F.array_sort(F.collect_set("page")).alias("pages_reviewed"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("error"))
    said = said.withColumn("whole", F.array_join(F.transform("o", lambda x: x["line"]), "\n")).drop("o")
    blank = F.when(review.T.strip(F.coalesce("text", F.lit(""))) == "", F.struct("page", F.format_string(UNREADABLE.replace("{}", "%d"), F.col("page").cast("int")).alias("note")))
    every = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"), F.transform(F.array_sort(F.collect_list(blank)), lambda x: x["note"]).alias("unreadable"))
    out = every.join(said, "doc_id", "left").join(_listed(found, finding, review.MOST_FINDINGS, "findings"), "doc_id", "left").join(_listed(points, point, review.MOST_POINTS, "key_points"), "doc_id", "left")
    complete = F.size(F.coalesce("pages_reviewed", F.array().cast("array<int>"))) == F.col("n_pages")
    too_much = (F.coalesce("key_points_n", F.lit(0)) > review.MOST_POINTS) | (F.coalesce("findings_n", F.lit(0)) > review.MOST_FINDINGS) | (F.length("whole") > review.MOST_OVERVIEW)
    notes = F.concat("unreadable", F.array_compact(F.array(F.when(~complete, F.lit(PARTLY)), F.when(too_much, F.lit(CUT)), F.lit(BY_PAGE))))
    error = F.when(F.col("whole").isNull() & F.col("error").isNull(), "no readable pages").when(F.col("error") != "", F.col("error"))
    out = out.withColumn("_error", error)
    good = lambda c: F.when(F.col("_error").isNull(), c)
    return out.select(
        "doc_id", good(F.substring("whole", 1, review.MOST_OVERVIEW)).alias("overview"), good(F.lit(VERDICT)).alias("verdict"), good(F.col("key_points")).alias("key_points"), good(F.col("findings")).alias("findings"),
        "pages_reviewed", complete.alias("complete"), F.slice(notes, 1, review.MOST_LIMITATIONS).alias("limitations"), F.col("_error").alias("error"),
    )
