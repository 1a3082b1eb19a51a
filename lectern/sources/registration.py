"""Registering made files under their owners' storage quota, with digests by which they are known again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..session import ship

#: Fixed value: bytes that an owner may store.
QUOTA = 500 * 1024 * 1024


def digests(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files with path and content."""
    return files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def stored_bytes(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """(owner, used): bytes by owner over tables given with their owner and size columns; null sizes are 0."""
    parts = [t.groupBy(F.col(owner).alias("owner")).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("n")) for t, owner, size in tables]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("owner").agg(F.sum("n").cast("long").alias("used"))


def is_flat() -> Column:
    """A made file is images only, by its own word."""
    return F.coalesce(F.col("flattened"), F.lit(False)) & ~F.coalesce(F.col("selectable_text"), F.lit(True))


def admit(requests: DataFrame, used: DataFrame, quota: int = QUOTA) -> DataFrame:
    """Requests with ``admitted``, ``reason`` (not_flattened, quota or null) and ``used_before``, the owner's bytes at that moment.

    ``requests`` has id, owner, at, size, flattened and selectable_text; ``used`` (owner, used) what owners store already.
    An owner's requests are taken in order of time and id. A refused one uses nothing, so what comes after may still fit:
    the total is a fold, and the rows of an owner, sorted, stream through a worker that holds one number. Requests without an
    owner are one owner's.
    """
    ship(requests.sparkSession)
    known = used.select(F.col("owner").alias("_owner"), F.col("used").alias("_used"))
    rows = requests.join(known, F.col("owner").eqNullSafe(F.col("_owner")), "left").drop("_owner")
    rows = rows.withColumn("_used", F.coalesce("_used", F.lit(0)).cast("long")).withColumn("_flat", is_flat()).withColumn("_size", F.coalesce("size", F.lit(0)).cast("long"))
    dealt = rows.repartition("owner").sortWithinPartitions("owner", "at", "id")
    kept = [f for f in dealt.schema.fields if f.name not in ("_used", "_flat", "_size")]
    out = StructType([*kept, StructField("admitted", BooleanType()), StructField("reason", StringType()), StructField("used_before", LongType())])

    def body(batches):
        now, total = (), 0
        for b in batches:
            told = []
            for owner, start, flat, size in zip(*(b.column(c).to_pylist() for c in ("owner", "_used", "_flat", "_size"))):
                if (owner,) != now:
                    now, total = (owner,), start
                reason = "not_flattened" if not flat else "quota" if total + size > quota else None
                told.append((reason is None, reason, total))
                total += size if reason is None else 0
            columns = list(zip(*told)) if told else [[]] * 3
            more = [pa.array(list(c), k) for c, k in zip(columns, (pa.bool_(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *more], names=out.names)

    return dealt.mapInArrow(body, out)


def artifact_rows(admitted: DataFrame, files: DataFrame, policy: str, detector: str) -> DataFrame:
    """New artifacts of the admitted requests: both digests, the versions in force and a report of pages yet to verify.

    Beside the columns of ``admit``: source_path, stored_path and page_count. ``files`` is what ``digests`` gives.
    """
    one = files.select("path", "sha256")
    rows = admitted.filter("admitted")
    for path, name in (("source_path", "source_sha256"), ("stored_path", "artifact_sha256")):
        rows = rows.join(one.select(F.col("path").alias(path), F.col("sha256").alias(name)), path, "left")
    pages = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    return rows.select(
        F.col("id").alias("artifact_id"), "owner", F.lit("verifying").alias("status"), "source_path", "stored_path", F.col("size").alias("size_bytes"), "source_sha256", "artifact_sha256",
        F.lit(policy).alias("policy_version"), F.lit(detector).alias("detector_version"), "flattened", "selectable_text", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.array().cast("array<int>").alias("checked_pages"), pages.alias("unchecked_pages"), F.lit(False).alias("verification_completed"),
    )


def with_hash_ok(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Artifacts with ``hash_ok``: the made file and its source are there and still have the digests of registration."""
    now = digests(files)
    out = artifacts
    for path, stored, mark in (("source_path", "source_sha256", "_a"), ("stored_path", "artifact_sha256", "_b")):
        out = out.join(now.select(F.col("path").alias(path), F.col("sha256").alias(mark)), path, "left")
        out = out.withColumn(mark, F.coalesce(F.col(mark) == F.col(stored), F.lit(False)))
    return out.withColumn("hash_ok", F.col("_a") & F.col("_b")).drop("_a", "_b")
