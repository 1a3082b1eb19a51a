"""Checks that quoted evidence is in the text it cites."""

from __future__ import annotations

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters below which a finding is not looked for.
LEAST_RESIDUAL = 3
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


@F.pandas_udf(StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    """NFKC, which no built-in function gives."""
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def quote_form(text: Column, ascii_only: bool = False) -> Column:
    """NFKC with white space collapsed; ``ascii_only`` skips NFKC for texts it cannot change."""
    return F.trim(F.regexp_replace(text if ascii_only else compatibility_form(text), r"\s+", " "))


def match_citations(citations: DataFrame, chunks: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Citations (doc_id, chunk_index, quote, ...) with text_matched and the chunk's page and quality."""
    source = chunks.select("doc_id", "chunk_index", F.col("text").alias("_text"), "page_number", "extraction_quality", "uncertain_region_count")
    joined = citations.join(source, ["doc_id", "chunk_index"], "left")
    needle = quote_form(F.col("quote"), ascii_only)
    found = F.coalesce((needle != "") & F.contains(quote_form(F.col("_text"), ascii_only), needle), F.lit(False))
    return joined.withColumn("text_matched", found).drop("_text")


def requires_review(conclusions: DataFrame, matched: DataFrame) -> DataFrame:
    """(conclusion_id, requires_review): no citation, one unmatched, weak source, or a number that no matched quote has."""
    weak = F.col("extraction_quality").isin("low", "medium") | (F.col("uncertain_region_count") > 0)
    per = matched.groupBy("conclusion_id").agg(
        F.bool_or(~F.col("text_matched")).alias("unmatched"),
        F.bool_or(F.col("text_matched") & F.coalesce(weak, F.lit(False))).alias("weak"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("text_matched"), F.regexp_extract_all("quote", F.lit(NUMBER), 0))))).alias("numbers"),
    )
    stated = F.regexp_extract_all("observation", F.lit(NUMBER), 0)
    missing = F.size(F.array_except(stated, F.coalesce("numbers", F.array().cast("array<string>")))) > 0
    out = conclusions.join(per, "conclusion_id", "left")
    return out.select("conclusion_id", (F.coalesce("unmatched", F.lit(True)) | F.coalesce("weak", F.lit(False)) | missing).alias("requires_review"))


def residual_text(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings (doc_id, text) whose text, white space off and folded, has three characters or more and is still in their document.

    Each document meets the distinct texts of all its findings at once, as one automaton, and is read once whatever their
    number. Null texts are in nothing and hold nothing; rows without a doc_id meet no document.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    rows = findings.withColumn("_bare", bare(F.col("text"))).filter(F.length("_bare") >= LEAST_RESIDUAL)
    sought = rows.groupBy("doc_id").agg(F.collect_set("_bare").alias("sought"))
    both = docs.select("doc_id", bare(F.col("text")).alias("bare")).join(sought, "doc_id")

    def body(batches):
        for b in batches:
            keys, found = [], []
            for key, text, sought_ in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                there = _occurring(text or "", sought_)
                keys += [key] * len(there)
                found += there
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], b.column(0).type), pa.array(found, pa.string())], names=["doc_id", "_bare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    there = both.mapInArrow(body, f"doc_id {kind}, _bare string").distinct()
    return rows.join(there, ["doc_id", "_bare"], "left_semi").drop("_bare")


def _occurring(text: str, sought: list[str]) -> list[str]:
    automaton = ahocorasick.Automaton()
    for s in sought:
        automaton.add_word(s, s)
    automaton.make_automaton()
    return sorted({s for _, s in automaton.iter(text)})
