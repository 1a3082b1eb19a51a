"""Consent to outside processing, copies at providers from storing to removal, tool jobs from request to result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .jobs import RETAINED, remote_in_use

# What a removal that failed leaves behind.
DELETE_FAILED, CLEANUP_FAILED, COPY_LEFT = "remote_delete_failed", "Remote cleanup failed: ", "External AI copy deletion failed"
WARNING = "The external AI copy could not be deleted; use 'delete external copy' to retry."


def asked_consent(mode: Column, consents: Column, acknowledges: Column) -> Column:
    """What a request for an analysis lacks, null for nothing; local processing needs no consent."""
    outside = ~mode.eqNullSafe("local")
    return F.when(outside & ~F.coalesce(consents, F.lit(False)), "consent_required").when(outside & ~F.coalesce(acknowledges, F.lit(False)), "terms_not_acknowledged")


def held_consent(jobs: DataFrame, tier: str, models: dict[str, str]) -> DataFrame:
    """Jobs with ``refused``: why a claimed job may not go on, null if it may.

    Columns: provider, external_processing, terms_acknowledged, service_tier, local_model and external_model as they were
    agreed to (a null model agrees to any). ``models`` has the models in use by "local" and "external".
    """
    agreed = lambda c, now: F.col(c).isNull() | (F.col(c) == now)
    both = F.coalesce("external_processing", F.lit(False)) & F.coalesce("terms_acknowledged", F.lit(False))
    outside = ~F.col("provider").isin("local", "ollama")
    why = (
        F.when(F.col("provider").isin("local", "ollama", "hybrid") & ~agreed("local_model", models["local"]), "local_model_changed")
        .when(outside & ~both, "consent_required")
        .when(outside & ~F.col("service_tier").eqNullSafe(tier), "terms_changed")
        .when(outside & ~agreed("external_model", models["external"]), "external_model_changed")
    )
    return jobs.withColumn("refused", why)


def store_copies(jobs: DataFrame, copies: DataFrame, now: Column) -> DataFrame:
    """Jobs after uploads: ``copies`` has id, name, uri and expires_at. Another copy's name starts its processing time anew."""
    new = copies.select("id", F.col("name").alias("_name"), F.col("uri").alias("_uri"), F.col("expires_at").alias("_expires"))
    out = jobs.join(new, "id", "left")
    came = F.col("_name").isNotNull()
    started = F.when(came & ~F.col("remote_name").eqNullSafe(F.col("_name")), now).otherwise(F.col("remote_started_at"))
    values = {
        "remote_started_at": started, "remote_uri": F.when(came, F.col("_uri")).otherwise(F.col("remote_uri")), "remote_expires_at": F.when(came, F.col("_expires")).otherwise(F.col("remote_expires_at")),
        "cleanup_status": F.when(came, F.when(F.col("retention") == RETAINED, "retained").otherwise("pending")).otherwise(F.col("cleanup_status")),
        "cleanup_error": F.when(~came, F.col("cleanup_error")), "remote_name": F.coalesce("_name", "remote_name"),
    }
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in jobs.columns])


def removals_due(jobs: DataFrame) -> DataFrame:
    """(provider, remote_name): copies of finished jobs that are not retained and that no active job uses."""
    ended = jobs.filter(F.col("status").isin("completed", "failed", "cancelled") & F.col("remote_name").isNotNull() & ~F.col("retention").eqNullSafe(RETAINED))
    return ended.select("provider", "remote_name").distinct().join(remote_in_use(jobs), ["provider", "remote_name"], "left_anti")


def removed(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs after removals: ``results`` has provider, remote_name, code (null: gone; 404: was gone) and message.

    All jobs that name a copy that is gone lose it and its warnings; where a removal failed they keep it, with a warning
    once, the first error that they had, and the failure as cleanup.
    """
    told = results.groupBy("provider", "remote_name").agg(F.max_by(F.struct("code", "message"), F.coalesce("code", F.lit(0))).alias("_r"))
    out = jobs.join(told, ["provider", "remote_name"], "left")
    known = F.col("_r").isNotNull()
    gone = known & (F.col("_r.code").isNull() | (F.col("_r.code") == 404))
    failed = known & ~gone
    bare = T.strip(F.replace(F.coalesce("public_error", F.lit("")), F.lit(WARNING), F.lit("")))
    cleaned = F.when(bare != "", bare)
    keep = lambda c: F.when(~gone, F.col(c))
    values = {
        "remote_name": keep("remote_name"), "remote_uri": keep("remote_uri"), "remote_expires_at": keep("remote_expires_at"), "remote_started_at": keep("remote_started_at"),
        "cleanup_status": F.when(gone, "deleted").when(failed, "failed").otherwise(F.col("cleanup_status")), "cleanup_error": F.when(failed, COPY_LEFT).when(~gone, F.col("cleanup_error")),
        "public_error": F.when(gone, cleaned).when(failed, F.concat_ws(" ", cleaned, F.lit(WARNING))).otherwise(F.col("public_error")),
        "error_code": F.when(gone & (F.col("error_code") == DELETE_FAILED), None).when(failed, F.coalesce("error_code", F.lit(DELETE_FAILED))).otherwise(F.col("error_code")),
        "private_error": F.when(gone & F.startswith("private_error", F.lit(CLEANUP_FAILED)), None)
        .when(failed & (F.coalesce("private_error", F.lit("")) == ""), F.concat(F.lit(CLEANUP_FAILED), F.coalesce("_r.message", F.lit(""))))
        .otherwise(F.col("private_error")),
    }
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in jobs.columns])


def tool_jobs_of(requests: DataFrame, now: Column) -> DataFrame:
    """New tool jobs of requests with owner, kind, filename, content_type, path and options: pending, without a result."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return requests.select(
        "id", "owner", "source_document_id", "kind", F.col("filename").alias("source_filename"), F.col("content_type").alias("source_content_type"), F.col("path").alias("source_path"), "options",
        F.lit("pending").alias("status"), F.lit("queued").alias("stage"), F.lit(0).alias("progress"), now.alias("created_at"),
        none("string", "result_path"), none("string", "result_filename"), none("string", "result_content_type"), none("long", "result_size"), none("string", "error"), none("timestamp", "finished_at"),
    )


def complete_tool_jobs(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Running tool jobs with a result (id, path, content_type, size) are completed; others stay, results of others are ignored."""
    made = results.select("id", F.col("path").alias("_path"), F.col("content_type").alias("_type"), F.col("size").alias("_size"))
    out = jobs.join(made, "id", "left")
    done = F.col("_path").isNotNull() & (F.col("status") == "running")
    values = {
        "status": F.lit("completed"), "stage": F.lit("completed"), "progress": F.lit(100), "result_path": F.col("_path"), "result_filename": F.element_at(F.split("_path", "/"), -1),
        "result_content_type": F.col("_type"), "result_size": F.col("_size").cast("long"), "error": F.lit(None).cast("string"), "finished_at": now,
    }
    return out.select(*[F.when(done, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns])


def with_documents(jobs: DataFrame, documents: DataFrame, columns: list[str]) -> DataFrame:
    """Running jobs with their document's columns; one whose document is gone has failed."""
    known = documents.select("doc_id", *columns, F.lit(True).alias("_known"))
    out = jobs.filter("status = 'running'").join(known, "doc_id", "left")
    lost = F.col("_known").isNull()
    return out.withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))).withColumn("error", F.when(lost, "Document no longer exists")).drop("_known")


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page, block, text): the paragraphs of pages, parted by blank lines and stripped; blank ones count for nothing."""
    parts = F.filter(F.transform(F.split(T.strip(F.coalesce("text", F.lit(""))), r"\n\s*\n", -1), T.strip), lambda b: b != "")
    return pages.select("doc_id", "page", F.posexplode(parts).alias("block", "text"))


def affected_pages(findings: DataFrame, supported: list[str]) -> DataFrame:
    """(doc_id, pages, categories): the number of pages with findings, and the categories found among the supported, sorted."""
    found = F.array_sort(F.array_intersect(F.collect_set("category"), F.array(*map(F.lit, supported))))
    return findings.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), found.alias("categories"))
