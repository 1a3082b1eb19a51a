"""Mixing sources to target weights.

Words are summed per source, every source gets a target, ``rate = target / source size``, and a document is
emitted ``floor(rate)`` times plus once more when a hash-seeded Bernoulli draw of probability ``rate - floor(rate)``
succeeds. The draw is the md5 of the seed and ``doc_id``, or the text's md5 where that is null: one draw a document, the
same in every run.

Defined cases: a null or empty text has size 0; a null source is a source of its own, last in order; a source of
size 0 has target and rate 0; repeated rows (same ``doc_id``) draw alike; a row without a ``doc_id`` draws by its text; an empty table gives an empty result; ``mix``
returns the input's columns, whatever their names; ``mix_plan`` adds columns to them and replaces those of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, table, word_count

#: Above so many sources the targets reach documents by a salted shuffle join and not by broadcast.
BROADCAST_SOURCES = 50_000
SALTS = 64
SEED, SPAN = "mix", 4294967296
ADDED = ("size", "source_size", "target", "rate", "copies")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target): water-filling under ``cap`` times the size.

    Ranks come from a range partitioning with per-partition offsets, and each round of resharing is one
    aggregate over the sources, so no step needs all sources in one task. The driver keeps one count per partition.
    """
    ranged = materialise(sizes.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offset, start = F.lit(0), 0
    for part in sorted(counts):
        offset, start = F.when(F.col("_part") == part, F.lit(start)).otherwise(offset), start + counts[part]
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1 + offset
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = materialise(ranged.withColumn("weight", weight).drop("_part"))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0
    while True:  # the level only rises, and every round but the last caps at least one more source
        full = F.col("source_size") * cap <= level * F.col("weight")
        held, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        risen = (total - held) / open_weight if open_weight else level
        if risen <= level:
            break
        level = risen
    return ranked.withColumn("target", F.least(F.col("source_size") * F.lit(float(cap)), F.lit(level) * F.col("weight")))


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Join on a null-safe source: broadcast when the sources were counted to be few, else salted against hot sources."""
    key = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")).alias("key")
    targets = targets.select(key, "source_size", "target", "rate")
    rows = rows.select(key, "row", "size", "draw")
    if targets.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(targets), "key")
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])


def _planned(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(row, size, source_size, target, rate, copies), with each document as a struct, so that no column names clash."""
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    digest = F.md5(F.concat_ws(":", F.lit(SEED), ident))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(SPAN))
    rows = docs.select("source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(F.col("text")).alias("size"), draw.alias("draw"))
    extra = (F.col("draw") < F.col("rate") - F.floor("rate")).cast("int")
    return _with_targets(rows, targets).withColumn("copies", (F.floor("rate") + extra).cast("int")).select("row", *ADDED)


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents with ``size, source_size, target, rate, copies``."""
    return _planned(docs, weights, share, cap).select(*[f"row.`{c}`" for c in docs.columns if c not in ADDED], *ADDED)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed corpus: each document ``copies`` times, with the columns of ``docs``."""
    planned = _planned(docs, weights, share, cap).filter("copies > 0")
    return planned.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ':' || md5(coalesce(text, ''))))), 1, 8))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS i FROM w),
c AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS total,
         coalesce(sum(2 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
         sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_weight
  FROM r),
l AS (SELECT (total - held) / open_weight AS level FROM c WHERE (total - held) / open_weight < 2.0 * source_size / weight ORDER BY i LIMIT 1),
t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size::DOUBLE, coalesce((SELECT level FROM l), 1e300) * weight::DOUBLE) AS target FROM r),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate FROM t),
x AS (SELECT d.*, q.source_size, q.target, q.rate, rate - floor(rate) AS fraction FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT x.doc_id, x.size, x.source_size, x.target,
       (x.size * (floor(rate) + CASE WHEN h::DOUBLE / {SPAN}.0::DOUBLE < fraction THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
