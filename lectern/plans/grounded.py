"""Answers from a model that must quote its sources: batches of excerpts in, checked and merged conclusions out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import chunking, evidence, review
from ..session import materialise

# Bounds of an answer, and what is said of its limits.
MOST_CONCLUSIONS, MOST_CITATIONS, MOST_NOTES, MOST_OBSERVATION = 12, 4, 10, 1200
NOTHING_FOUND = "В доступных фрагментах недостаточно информации для ответа."
IN_PARTS = "Части документа анализировались последовательно; связи между разными частями могут быть пропущены."
SELECTED = "Ответ основан на выбранных фрагментах, а не на проверке всего документа."
LIMITS = "Ограничения: "
_TEXT = lambda most, least=0, **more: {"kind": "string", "least": least, "most": most} | more
_CITATION = {"kind": "object", "fields": {"chunk_index": {"kind": "integer", "from": 0}, "quote": _TEXT(500, 1)}}
_CONCLUSION = {
    "kind": "object",
    "fields": {"observation": _TEXT(MOST_OBSERVATION, 1), "citations": {"kind": "array", "most": MOST_CITATIONS, "items": _CITATION, "optional": True}, "suggestion": _TEXT(MOST_OBSERVATION, optional=True)},
}
ANSWER = {
    "kind": "object",
    "fields": {"conclusions": {"kind": "array", "most": MOST_CONCLUSIONS, "items": _CONCLUSION, "optional": True}, "limitations": {"kind": "array", "most": MOST_NOTES, "items": _TEXT(100_000), "optional": True}},
}
_SHAPE = "conclusions array<struct<observation string, citations array<struct<chunk_index int, quote string>>, suggestion string>>, limitations array<string>"


def excerpt_batches(contexts: DataFrame, most: int = review.CHAT_CHARS) -> DataFrame:
    """(key, batch, excerpts, n_batches) for (key, chunk_index, text, ...): excerpts in order, under their headers."""
    sized = chunking.greedy_batches(contexts.select(F.col("key").alias("doc_id"), "chunk_index", "text"), most, separator=0).withColumnRenamed("doc_id", "key")
    rows = contexts.withColumn("excerpt", review.retrieval_context()).join(sized, ["key", "chunk_index"])
    batches = rows.groupBy("key", "batch").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "excerpt"))).alias("e"))
    told = batches.select("key", "batch", F.array_join(F.transform("e", lambda e: e["excerpt"]), "\n\n").alias("excerpts"))
    return told.join(batches.groupBy("key").agg(F.count("*").alias("n_batches")), "key")


def grounded_answers(contexts: DataFrame, questions: DataFrame, generate: Callable[[Column, Column], Column], most: int = review.CHAT_CHARS) -> DataFrame:
    """(question_id, doc_id, answer, n_conclusions, limitations, pages_reviewed, truncated_context, error).

    ``contexts`` has the chunks that each question reads of a document: question_id, doc_id, chunk_index, page_number, text,
    extraction_method, extraction_quality, confidence, uncertain_region_count and total_chunks, those the document has;
    ``questions`` question_id and question. ``generate(question, excerpts)`` is a column function to a JSON text.

    Every batch is asked once, its answer is written before anything is made of it. A conclusion may cite the excerpts
    of its own batch only; quotes are looked up in them, and what they do not bear out is marked for review. An answer
    that breaks its schema is told as ``error`` of the whole question and document, without an answer.
    """
    contexts = contexts.withColumn("key", F.struct("question_id", "doc_id"))
    batches = excerpt_batches(contexts, most)
    asked = batches.withColumn("question_id", F.col("key.question_id")).join(questions.select("question_id", "question"), "question_id")
    told = materialise(asked.select("key", "batch", "n_batches", generate(F.col("question"), F.col("excerpts")).alias("raw")))
    told = told.withColumn("wrong", answers.violations(F.col("raw"), ANSWER)).withColumn("parsed", F.from_json("raw", _SHAPE))

    whole = F.struct("key", "batch")
    stated = told.filter(F.size("wrong") == 0).select("key", whole.alias("batch_key"), F.posexplode("parsed.conclusions").alias("place", "c"))
    conclusions = stated.select(F.col("key").alias("question_id"), "batch_key", F.struct("batch_key.batch", "batch_key.key", "place").alias("conclusion_id"), "c.observation", F.coalesce("c.suggestion", F.lit("")).alias("suggestion"), "c.citations")
    cited = conclusions.select("conclusion_id", F.col("batch_key").alias("doc_id"), F.posexplode("citations").alias("place", "q")).select("conclusion_id", "doc_id", "place", "q.*")
    sized = chunking.greedy_batches(contexts.select(F.col("key").alias("doc_id"), "chunk_index", "text"), most, separator=0).withColumnRenamed("doc_id", "key")
    sources = contexts.join(sized, ["key", "chunk_index"]).drop("doc_id").withColumn("doc_id", whole)
    matched = materialise(evidence.match_citations(cited, sources))
    checked = conclusions.join(evidence.requires_review(conclusions.select("conclusion_id", "observation"), matched), "conclusion_id")
    lines = review.answers(checked, matched.withColumn("page", F.col("page_number"))).select(F.col("question_id").alias("key"), F.col("answer").alias("lines"))

    nothing = F.array().cast("array<string>")
    notes = told.groupBy("key").agg(
        F.max("n_batches").alias("n_batches"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch", F.coalesce("parsed.limitations", nothing).alias("n")))), lambda x: x["n"])).alias("notes"),
        F.sum(F.size(F.coalesce("parsed.conclusions", F.from_json(F.lit("[]"), "array<struct<observation string, citations array<struct<chunk_index int, quote string>>, suggestion string>>")))).alias("n_conclusions"),
        F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch", "wrong"))), lambda x: x["wrong"])), "; ").alias("error"),
    )
    read = contexts.groupBy("key").agg(F.array_sort(F.collect_set("page_number")).alias("pages_reviewed"), (F.count("*") < F.max("total_chunks")).alias("truncated_context"))
    out = notes.join(read, "key").join(lines, "key", "left").withColumn("error", F.when(F.col("error") != "", F.col("error")))
    added = F.array_compact(F.array(F.when(F.col("n_batches") > 1, F.lit(IN_PARTS)), F.when(F.col("truncated_context"), F.lit(SELECTED))))
    out = out.withColumn("limitations", F.array_distinct(F.concat("notes", added)))
    closing = F.when(F.size("limitations") > 0, F.concat(F.lit(LIMITS), F.array_join("limitations", " ")))
    answer = F.when(F.col("lines").isNull(), F.concat_ws("\n", F.lit(NOTHING_FOUND), closing)).otherwise(F.concat_ws("\n\n", "lines", closing))
    return out.select("key.question_id", "key.doc_id", F.when(F.col("error").isNull(), answer).alias("answer"), F.col("n_conclusions").cast("int").alias("n_conclusions"), "limitations", "pages_reviewed", "truncated_context", "error")
