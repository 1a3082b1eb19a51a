"""A training corpus in five stages, each one operator over all that the stage before kept.

Toxic documents go; of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the least
``doc_id`` stays; personal data is redacted; sources are mixed to their target weights, which repeats or drops
documents; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, mixing, ngram_join, pii, toxicity
from lectern.session import discard, materialise, table

SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs, SHINGLE_WORDS, *SIMILARITY)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_ids(docs, *bpe.public_vocabulary()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Compression lengths, boosted trees and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)  # all that it led to is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
