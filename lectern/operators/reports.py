"""Relational statements over the stores: dashboard, storage, search, histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dashboard(docs: DataFrame, owner: str = "owner") -> DataFrame:
    """Per owner in one pass: documents, processed, failed and bytes. ``docs`` has status and size_bytes."""
    return docs.groupBy(owner).agg(
        F.count("*").alias("total_documents"),
        F.count_if(F.col("status") == "processed").alias("processed_documents"),
        F.count_if(F.col("status") == "failed").alias("failed_documents"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("storage_bytes"),
    )


def storage(*stores: DataFrame) -> DataFrame:
    """Bytes per owner over several stores with owner and size_bytes."""
    parts = [s.groupBy("owner").agg(F.sum("size_bytes").alias("size_bytes")) for s in stores]
    return reduce(DataFrame.unionByName, parts).groupBy("owner").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("storage_bytes"))


def library_search(docs: DataFrame, query: str, fields: list[str], status: Column | None = None) -> DataFrame:
    """Rows any of whose fields contains the trimmed, lower-cased query; an empty query matches all."""
    q = query.strip().lower()
    hit = reduce(Column.__or__, [F.coalesce(F.lower(F.col(f).cast("string")).contains(q), F.lit(False)) for f in fields]) if q else F.lit(True)
    return docs.filter(hit if status is None else status & hit)


def recent_or_active(jobs: DataFrame, active: Column, limit: int = 50, artifacts: DataFrame | None = None) -> DataFrame:
    """The newest ``limit`` jobs by (created_at, id), all active ones, and those whose artifact is being verified.

    The keys meet in a union and one semi-join. ``artifacts`` has artifact_id and status; jobs then have artifact_id.
    """
    recent = jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id")
    keys = recent.union(jobs.filter(active).select("id"))
    if artifacts is not None:
        keys = keys.union(linked_verifying(jobs, artifacts).select("id"))
    return jobs.join(keys.distinct(), "id", "left_semi")


def linked_verifying(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    return jobs.join(artifacts.filter("status = 'verifying'").select("artifact_id").distinct(), "artifact_id", "left_semi")


def job_history(jobs: DataFrame, artifacts: DataFrame, hidden: bool = False, document: int | None = None, shown: int = 5) -> DataFrame:
    """(id, part, place): per owner the active jobs, then the newest ``shown`` finished ones of the wanted scope.

    A job is active by its status or while its artifact is being verified. ``jobs`` has owner, artifact_id, document_id,
    hidden and created_at.
    """
    verifying = linked_verifying(jobs, artifacts).select("id").withColumn("_v", F.lit(True))
    active = F.col("status").isin("pending", "running", "review") | F.col("_v").isNotNull()
    scope = F.lit(True) if document is None else F.col("document_id") == document
    told = jobs.join(verifying, "id", "left").withColumn("part", F.when(active, "active").when((F.coalesce("hidden", F.lit(False)) == hidden) & scope, "history"))
    w = Window.partitionBy("owner", "part").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = told.filter("part is not null").withColumn("place", F.row_number().over(w))
    return ranked.filter((F.col("part") == "active") | (F.col("place") <= shown)).select("id", "part", "place")


def owned(rows: DataFrame, owner, key: Column | None = None) -> DataFrame:
    """An owner's rows, or the one of a key: a row of somebody else is not there at all."""
    mine = F.col("owner").eqNullSafe(owner)
    return rows.filter(mine if key is None else mine & key)


def with_source(artifacts: DataFrame, docs: DataFrame) -> DataFrame:
    """Artifacts with the source document of the same owner; others have none."""
    source = docs.select(F.col("doc_id").alias("source_id"), "owner", F.lit(True).alias("source_found"))
    return artifacts.join(source, ["source_id", "owner"], "left").withColumn("source_found", F.coalesce("source_found", F.lit(False)))


def downloadable(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Verified or reviewable artifacts whose file is there."""
    return artifacts.filter(F.col("status").isin("ready_for_ai", "needs_review")).join(files.select("path").distinct(), "path", "left_semi")


def language_display(shares: DataFrame) -> DataFrame:
    """(doc_id, languages): languages with a positive share, the largest first."""
    some = shares.filter("share > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "lang"))).alias("l"))
    return some.select("doc_id", F.array_join(F.transform("l", lambda x: x["lang"]), ", ").alias("languages"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
