"""Overlapping chunks, per-chunk facts and language shares."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.workers import bounded_batches, return_memory, slices

# Chunk length and overlap in characters.
SIZE, OVERLAP = 1600, 150


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of the stripped text, of at most ``size`` characters each, ``overlap`` of them shared with the chunk before.

    A chunk that is not the last ends on the last line break of its second half, else on the last space there. All break
    positions are listed once; each chunk looks its end up in the two lists.
    """
    text = text.strip()
    breaks = [[m.start() for m in re.finditer(c, text)] for c in ("\n", " ")]

    def end_of(start: int) -> int:
        for places in breaks:
            i = bisect_left(places, start + size) - 1
            if i >= 0 and places[i] >= start + size // 2:
                return places[i]
        return start + size

    spans, start = [], 0
    while len(text) - start > size:
        spans.append((start, end_of(start)))
        start = max(spans[-1][1] - overlap, start + 1)
    spans.append((start, len(text)))
    return [piece for a, b in spans if (piece := text[a:b].strip())]


def chunk(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, page_number, text) to (doc_id, page_number, chunk_index, text), numbered through each document's pages.

    The cuts depend on each other, so a worker makes them; the numbering is a window over each document's chunks. Documents
    of one page need none: see ``chunk_documents``.
    """
    import pyarrow as pa

    bounded_batches(pages.sparkSession)

    def body(batches):
        for b in slices(batches):
            rows = [(d, p, i, c) for d, p, t in zip(*(x.to_pylist() for x in b.columns)) for i, c in enumerate(cut(t or "", size, overlap))]
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "page_number", "place", "text"])

    cuts = pages.select("doc_id", F.col("page_number").cast("int"), "text").mapInArrow(body, "doc_id long, page_number int, place int, text string")
    order = Window.partitionBy("doc_id").orderBy("page_number", "place")
    return cuts.withColumn("chunk_index", F.row_number().over(order) - 1).drop("place")


def chunk_documents(docs: DataFrame, *kept: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, page_number, chunk_index, text, and the columns ``kept``) of documents that are one page each, in one pass.

    The worker that cuts a text numbers its chunks and repeats what goes with them, so nothing is shuffled or joined. A
    null text has no chunk.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    fields = [docs.schema["doc_id"], *[docs.schema[c] for c in kept]]
    out = StructType([fields[0], StructField("page_number", IntegerType()), StructField("chunk_index", IntegerType()), StructField("text", StringType()), *fields[1:]])

    def body(batches):
        for b in slices(batches):
            pieces = [cut(t or "", size, overlap) for t in b.column(1).to_pylist()]
            rows = pa.array([i for i, p in enumerate(pieces) for _ in p], pa.int64())
            places = [k for p in pieces for k in range(len(p))]
            more = [b.column(2 + k).take(rows) for k in range(len(kept))]
            columns = [b.column(0).take(rows), pa.array([1] * len(places), pa.int32()), pa.array(places, pa.int32()), pa.array([c for p in pieces for c in p], pa.string()), *more]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.select("doc_id", "text", *kept).mapInArrow(body, out)


def documents_as_pages(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit(1).alias("page_number"), "text", "lang")


def chunk_facts(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("word_count", T.word_count(F.col("text"))).withColumn("char_count", F.length("text").cast("long"))


def language_distribution(chunks: DataFrame) -> DataFrame:
    """(doc_id, lang, share, first_chunk): each language's share of the characters, rounded to 4 places."""
    sized = chunks.filter("lang is not null").groupBy("doc_id", "lang").agg(F.sum(F.greatest("char_count", F.lit(1))).alias("n"), F.min("chunk_index").alias("first_chunk"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return sized.select("doc_id", "lang", F.round(F.col("n") / total, 4).alias("share"), "first_chunk")


def primary_language(shares: DataFrame) -> DataFrame:
    """The largest share; of equal ones the language that came first."""
    return shares.groupBy("doc_id").agg(F.max_by("lang", F.struct("share", -F.col("first_chunk"))).alias("primary_language"))


def language_totals(shares: DataFrame) -> DataFrame:
    return shares.groupBy("lang").agg(F.round(F.sum("share"), 4).alias("total"))


def overlap_length(tail, head, least: int = 20, most: int = OVERLAP):
    """Length of the longest end of ``tail`` (20 to 150 characters) that ``head`` starts with, else 0.

    The two are the last and first ``most`` characters of the texts. A longer overlap begins further left, where ``tail`` holds
    the first ``least`` characters of ``head``: mostly at the first such place or nowhere, so other lengths are seldom tried.
    """
    at = F.call_function("instr", tail, F.substring(head, 1, least))
    first = F.length(tail) - at + 1
    sizes = F.filter(F.sequence(F.lit(most), F.lit(least), F.lit(-1)), lambda k: (k <= F.length(tail)) & (k <= F.length(head)) & tail.endswith(F.substring(head, F.lit(1), k)))
    tried = F.coalesce(F.try_element_at(sizes, F.lit(1)), F.lit(0))
    none = (F.length(head) < least) | (at == 0)
    return F.coalesce(F.when(none, 0).when(head.startswith(F.call_function("substring", tail, at)), F.when(first >= least, first).otherwise(0)).otherwise(tried), F.lit(0))


def trim_overlaps(chunks: DataFrame) -> DataFrame:
    """Cut from each chunk what the chunk before it on the same page ends with."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = F.lag(F.struct("chunk_index", "page_number", F.right("text", F.lit(OVERLAP)).alias("tail"))).over(order)
    bare = chunks.filter(F.trim("text") != "").withColumn("_before", before).withColumn("_head", F.substring("text", 1, OVERLAP))
    follows = (F.col("_before.chunk_index") == F.col("chunk_index") - 1) & F.col("_before.page_number").eqNullSafe(F.col("page_number"))
    marked = bare.withColumn("_tail", F.when(follows, F.col("_before.tail"))).withColumn("overlap", overlap_length(F.col("_tail"), F.col("_head")))
    return marked.withColumn("text", F.expr("substring(text, overlap + 1)")).drop("_before", "_head", "_tail")


def greedy_batches(chunks: DataFrame, limit: int = 6500, separator: int = 2) -> DataFrame:
    """(doc_id, chunk_index, batch): chunks in order fill batches of at most ``limit`` characters.

    Lengths alone are shuffled; a document's, sorted, stream through a worker that holds its batch and its size.
    """
    import pyarrow as pa

    bounded_batches(chunks.sparkSession)
    sized = chunks.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.length("text").alias("n"))
    dealt = sized.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index")
    out = StructType([*sized.schema.fields[:2], StructField("batch", IntegerType())])

    def body(batches):
        now, batch, size = (), 0, 0
        for b in batches:
            found = []
            for doc, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if now != (doc,):
                    now, batch, size = (doc,), 0, 0
                grown = size + (separator if size else 0) + (n or 0)
                if size and grown > limit:
                    batch, grown = batch + 1, n or 0
                size = grown
                found.append(batch)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int32())], names=out.names)
        return_memory()

    return dealt.mapInArrow(body, out)
