"""Whole flows: analysis of documents, asking questions, and model map-reduce with a pluggable generator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, retrieval
from ..session import materialise


def analyze(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts per document, chunks) of documents with doc_id, text and lang."""
    chunks = chunking.chunk_facts(chunking.chunk_documents(docs, "lang"))
    shares = chunking.language_distribution(chunks)
    facts = docs.select("doc_id", T.word_count(F.col("text")).alias("word_count"), T.char_count(F.col("text")).alias("char_count"))
    by_doc = shares.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "share"))).alias("language_distribution"))
    return facts.join(by_doc, "doc_id", "left").join(chunking.primary_language(shares), "doc_id", "left"), chunks


def ask(chunks: DataFrame, questions: DataFrame, k: int = retrieval.TOP) -> DataFrame:
    """Context of each question and document: all chunks of documents with at most ``k``, else the best ``k``; in order of the text.

    The chunks are cut once and written; every question meets every document by a generator over the questions' ids.
    """
    chunks = materialise(chunks)
    ids = [r[0] for r in questions.select("question_id").distinct().collect()]  # questions of one request
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    every = chunks.select("doc_id", "chunk_index").join(n, "doc_id").withColumn("question_id", F.explode(F.array(*map(F.lit, ids))))
    scored = retrieval.bm25(chunks.join(n.filter(F.col("n_chunks") > k), "doc_id", "left_semi"), questions)
    ranked = every.join(scored, ["question_id", "doc_id", "chunk_index"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy(F.desc("score"), "chunk_index"))
    kept = ranked.withColumn("_place", place).filter((F.col("n_chunks") <= k) | (F.col("_place") <= k))
    return kept.select("question_id", "doc_id", "chunk_index", F.when(F.col("n_chunks") <= k, "full_document").otherwise("bm25").alias("method"))


def ask_hybrid(chunks: DataFrame, questions: DataFrame, chunk_vectors: DataFrame | None, question_vectors: DataFrame | None, k: int = retrieval.TOP) -> DataFrame:
    """``ask`` with lexical and vector ranks fused where vectors are there; without them ``bm25`` alone, with a note.

    ``chunk_vectors`` has doc_id, chunk_index and embedding, one row a text (a join stands for a cache), ``question_vectors``
    question_id and embedding. Documents of at most ``k`` chunks give all of them.
    """
    lexical = ask(chunks, questions, k)
    if chunk_vectors is None or question_vectors is None:
        return lexical.withColumn("note", F.when(F.col("method") == "bm25", "vector search unavailable"))
    chunks = materialise(chunks)
    large = chunks.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > k).select("doc_id")
    key = F.struct("doc_id", "chunk_index").alias("item")
    vectors = chunk_vectors.join(large, "doc_id", "left_semi").select("doc_id", key, "embedding")
    asked = [(r["question_id"], r["embedding"]) for r in question_vectors.select("question_id", "embedding").collect()]  # questions of one request
    near = vectors.select("doc_id", "item", F.explode(F.array(*[F.struct(F.lit(i).alias("question_id"), retrieval.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in e])).alias("score")) for i, e in asked])).alias("s")).select("doc_id", "item", "s.*")
    words = retrieval.bm25(chunks.join(large, "doc_id", "left_semi"), questions).select("question_id", "doc_id", key, "score").filter("score > 0")
    rank = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy(F.desc("score"), "item.chunk_index"))).select("question_id", "doc_id", "item", (1 / (F.lit(60.0) + F.col("r"))).alias("rrf"))
    fused = rank(near).unionByName(rank(words)).groupBy("question_id", "doc_id", "item").agg(F.sum("rrf").alias("rrf"))
    best = fused.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy(F.desc("rrf"), "item.chunk_index"))).filter(F.col("_n") <= k)
    hybrid = best.select("question_id", "doc_id", "item.chunk_index", F.lit("hybrid").alias("method"))
    return lexical.filter("method = 'full_document'").unionByName(hybrid).withColumn("note", F.lit(None).cast("string"))


def map_reduce(chunks: DataFrame, generate, limit: int = 12_000) -> DataFrame:
    """(doc_id, answer): ``generate`` on each chunk, then on joined batches of at most ``limit`` characters until one is left.

    ``generate`` is a column function from text to text. A document of one chunk is generated once. Each round is written, so
    no answer is made twice, and documents that are done leave. A document that a round does not shrink is an error.
    """
    parts = materialise(chunks.select("doc_id", "chunk_index", generate(F.col("text")).alias("text")))
    done, left = [], None
    while True:
        n = parts.groupBy("doc_id").agg(F.count("*").alias("n"))
        done.append(parts.join(n.filter("n = 1"), "doc_id", "left_semi").select("doc_id", F.col("text").alias("answer")))
        open_ = materialise(parts.join(n.filter("n > 1"), "doc_id"))
        if left is not None and not open_.select("doc_id", F.col("n").cast("long")).distinct().join(left, "doc_id").filter("n >= before").isEmpty():
            raise ValueError("the batches of a document do not get fewer")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        left = open_.select("doc_id", F.col("n").alias("before")).distinct()
        parts = open_.drop("n")
        batches = chunking.greedy_batches(parts, limit)
        joined = parts.join(batches, ["doc_id", "chunk_index"]).groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
        text = F.array_join(F.transform("c", lambda c: c["text"]), "\n\n")
        parts = materialise(joined.select("doc_id", F.col("batch").alias("chunk_index"), generate(text).alias("text")))
