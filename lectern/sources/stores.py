"""Reading and ingesting files, and versioned writes of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import user_name
from ..operators.jobs import delete_for_artifacts

# Limits of an upload.
MAX_BYTES, MAX_PAGES, MAGIC = 50 * 1024 * 1024, 40, b"%PDF-"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def validate_uploads(files: DataFrame) -> DataFrame:
    """Files with a reject code, null for good ones; the cheap checks come before any engine sees the bytes."""
    code = F.when(F.col("length") == 0, 400).when(F.col("length") > MAX_BYTES, 413).when(~F.startswith("content", F.lit(MAGIC)), 400)
    return files.withColumn("reject_code", code)


def extract_pages(files: DataFrame, engine) -> DataFrame:
    """(path, page_number, text, error) by a pluggable ``engine(bytes) -> list of texts``; a failure is a row, not an exception."""
    import pandas as pd

    def body(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i + 1, t, None) for i, t in enumerate(engine(bytes(content)))]
                except Exception as e:  # noqa: BLE001  whatever the engine raises belongs to the file
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:240]))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"]).astype({"page_number": "Int64"})

    return files.select("path", "content").mapInPandas(body, "path string, page_number int, text string, error string")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of their key; the rest stays."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.select(*current.columns))


def partial_update(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where they are not null."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = current.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns])


def cascade_delete(gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each child table without the rows whose foreign key is among the deleted keys."""
    return [child.join(gone.select(F.col(key).alias(fk)).distinct(), fk, "left_anti") for child, fk in children]


def sweep_sessions(sessions: DataFrame, docs: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(sessions left, documents left): documents of expired sessions go when they have no owner, else lose the session."""
    expired = sessions.filter(F.col("expires_at") <= now).select("session_id")
    left = sessions.join(expired, "session_id", "left_anti")
    marked = docs.join(expired.withColumn("_gone", F.lit(True)), "session_id", "left")
    kept = marked.filter(F.col("_gone").isNull() | F.col("owner").isNotNull())
    return left, kept.withColumn("session_id", F.when(F.col("_gone").isNull(), F.col("session_id"))).drop("_gone")


def sweep_chunks(chunks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Chunks without those of documents that a sweep has removed."""
    return chunks.join(before.select("doc_id").join(after.select("doc_id"), "doc_id", "left_anti"), "doc_id", "left_anti")


def delete_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame, analysis_jobs: DataFrame, tool_jobs: DataFrame, artifacts: DataFrame, ai_jobs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(tables left, files to remove, documents refused) after deleting documents (doc_id) and all that hangs on them.

    Chunks and analysis jobs go by doc_id, tool jobs and artifacts by source_document_id, AI jobs by their artifact. A
    document stays, with everything, where one of its artifacts has an active AI job or a copy at a provider that an active
    job uses. The files are the results of the tool jobs and the artifacts' own, as ``path``.
    """
    asked = gone.select("doc_id").distinct()
    theirs = artifacts.join(asked.withColumnRenamed("doc_id", "source_document_id"), "source_document_id", "left_semi")
    held = delete_for_artifacts(ai_jobs, theirs)[1]
    refused = theirs.join(held, "artifact_id", "left_semi").select(F.col("source_document_id").alias("doc_id")).distinct()
    going = asked.join(refused, "doc_id", "left_anti")
    by_source = going.withColumnRenamed("doc_id", "source_document_id")
    doomed = artifacts.join(by_source, "source_document_id", "left_semi")
    left = {
        "documents": documents.join(going, "doc_id", "left_anti"), "chunks": chunks.join(going, "doc_id", "left_anti"), "analysis_jobs": analysis_jobs.join(going, "doc_id", "left_anti"),
        "tool_jobs": tool_jobs.join(by_source, "source_document_id", "left_anti"), "artifacts": artifacts.join(by_source, "source_document_id", "left_anti"), "ai_jobs": ai_jobs.join(doomed.select("artifact_id").distinct(), "artifact_id", "left_anti"),
    }
    results = tool_jobs.join(by_source, "source_document_id", "left_semi").select(F.col("result_path").alias("path"))
    files = results.unionByName(doomed.select(F.col("stored_path").alias("path"))).filter("path is not null").distinct()
    return left, files, refused


def claim_ownerless(docs: DataFrame, owner: str) -> tuple[DataFrame, int]:
    """(documents, number of those without an owner, which now have this one)."""
    claimed = docs.filter("owner is null").count()
    return docs.withColumn("owner", F.coalesce("owner", F.lit(owner))), claimed


#: Fields of a document that a new text makes void.
DERIVED = ("ai_summary", "content_review", "layout_review", "ai_error")


def overwrite_texts(docs: DataFrame, chunks: DataFrame, changes: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) after new texts by doc_id: what was derived from the old text goes, chunks are cut anew.

    ``cut`` makes (doc_id, chunk_index, text) of (doc_id, text).
    """
    new = changes.select("doc_id", F.col("text").alias("_text"))
    joined = docs.join(new, "doc_id", "left")
    changed = F.col("_text").isNotNull()
    out = joined.select(*[F.when(changed, F.col("_text")).otherwise(F.col(c)).alias(c) if c == "text" else F.when(~changed, F.col(c)).alias(c) if c in DERIVED else F.col(c) for c in docs.columns])
    return out, chunks.join(changes.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(cut(changes).select(*chunks.columns))


def delete_artifacts(artifacts: DataFrame, jobs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts, tool jobs): the artifacts go, and with them their results in tool jobs."""
    keys = gone.select("artifact_id").distinct()
    marked = jobs.join(keys.withColumn("_gone", F.lit(True)), "artifact_id", "left")
    cleared = marked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c in ("artifact_id", "result_path", "result_size") else F.col(c) for c in jobs.columns])
    return artifacts.join(keys, "artifact_id", "left_anti"), cleared


def detach_session(docs: DataFrame, session: str) -> DataFrame:
    """Documents of a deleted session stay, without it."""
    return docs.withColumn("session_id", F.when(~F.col("session_id").eqNullSafe(session), F.col("session_id")))


def add_users(users: DataFrame, names: DataFrame) -> DataFrame:
    """Users by normalised name; a name that is there, or twice among the new, is one user."""
    new = names.select(user_name(F.col("name")).alias("normalized")).filter("normalized is not null").distinct().join(users, "normalized", "left_anti")
    return users.unionByName(new.select(*[F.col(c) if c == "normalized" else F.lit(None).cast(users.schema[c].dataType).alias(c) for c in users.columns]))


def session_user(sessions: DataFrame, users: DataFrame, tokens: DataFrame, now) -> DataFrame:
    """(token, user_id): the user of the session that a token's sha256 names, null for none or an expired one."""
    live = sessions.filter(F.col("expires_at") > now).select("token_hash", "user_id")
    known = live.join(users.select("user_id"), "user_id")
    return tokens.withColumn("token_hash", F.sha2("token", 256)).join(known, "token_hash", "left").select("token", "user_id")


def seed_if_empty(docs: DataFrame, row: tuple) -> DataFrame:
    """The table, or one demonstration row where it is empty."""
    return docs.sparkSession.createDataFrame([row], docs.schema) if docs.isEmpty() else docs


def reject_pages(files: DataFrame, engine) -> DataFrame:
    """(path, page_count, reject_code) by ``engine(bytes) -> (encrypted, pages)``: encrypted or empty 400, too many pages 413."""
    import pandas as pd

    def told(content: bytes) -> tuple:
        try:
            encrypted, pages = engine(content)
        except Exception:  # noqa: BLE001  whatever the engine raises makes the file unreadable
            return None, 400
        return pages, 400 if encrypted or pages == 0 else 413 if pages > MAX_PAGES else None

    def body(batches):
        for pdf in batches:
            rows = [(p, *told(bytes(c))) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "page_count", "reject_code"]).astype({"page_count": "Int64", "reject_code": "Int64"})

    return files.select("path", "content").mapInPandas(body, "path string, page_count int, reject_code int")


def read_with_fallback(files: DataFrame, engines: list) -> DataFrame:
    """Pages by the first engine that reads a file without error and finds text, else by the last."""

    def ladder(content: bytes) -> list[str]:
        for engine in engines[:-1]:
            try:
                pages = engine(content)
            except Exception:  # noqa: BLE001, S112  the next engine tries
                continue
            if any(p.strip() for p in pages):
                return pages
        return engines[-1](content)

    return extract_pages(files, ladder)


def read_pages(files: DataFrame, engines: list, good=lambda text: bool(text.strip())) -> DataFrame:
    """(path, page_number, text, engine, error): every page by the first engine whose text of it is ``good``, else by the last
    that gave any.

    An engine is (bytes to number of pages, (bytes, page from 0) to text). What it raises on a page makes that page's text
    empty, and the next engine tries; a file whose pages no engine can count is one row with an error.
    """

    def counted(content: bytes) -> tuple:
        error = None
        for count, _ in engines:
            try:
                return count(content), None
            except Exception as e:  # noqa: BLE001  whatever the engine raises belongs to the file
                error = f"{type(e).__name__}: {e}"[:240]
        return None, error

    def page(content: bytes, i: int) -> tuple:
        best = ("", None)
        for k, (_, text) in enumerate(engines):
            try:
                found = text(content, i) or ""
            except Exception:  # noqa: BLE001  the page is empty to this engine
                found = ""
            if good(found):
                return found, k
            best = (found, k) if found else best
        return best

    def body(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                data = bytes(content or b"")
                n, error = counted(data)
                rows += [(path, None, None, None, error)] if n is None else [(path, i + 1, *page(data, i), None) for i in range(n)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "engine", "error"]).astype({"page_number": "Int64", "engine": "Int64"})

    return files.select("path", "content").mapInPandas(body, "path string, page_number int, text string, engine int, error string")


def valid_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors with a ``problem``: wrong_size, not_finite or zero; null for good ones."""
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.withColumn("problem", F.when(F.size(v) != size, "wrong_size").when(~finite, "not_finite").when(~F.exists(v, lambda x: x != 0), "zero"))
