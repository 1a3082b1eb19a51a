"""Uploads as a stream of files: good ones and those refused, each batch written once however often it runs."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .stores import MAGIC, MAX_BYTES, reject_pages

# What a Word upload may be called, and its type.
WORD_TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "odt": "application/vnd.oasis.opendocument.text",
}
#: What the central directory of a zip of that kind must name, and how the others begin.
ZIP_PARTS, OLD_WORD = {"docx": "word/document.xml", "odt": "content.xml"}, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
EMPTY, TOO_LARGE, NOT_SUPPORTED = 400, 413, 415


def _extension():
    return F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))


def check_pdfs(files: DataFrame, engine=None) -> DataFrame:
    """Files with ``reject_code`` and ``reason``, null for good ones: size, emptiness and first bytes, then what ``engine``
    (bytes to encrypted, pages) says of those that passed."""
    rules = [(F.col("length") > MAX_BYTES, TOO_LARGE, "too_large"), (F.col("length") == 0, EMPTY, "empty"), (~F.coalesce(F.startswith("content", F.lit(MAGIC)), F.lit(False)), NOT_SUPPORTED, "not_a_pdf")]
    files = _told(files, rules)
    if engine is None:
        return files
    passed = reject_pages(files.filter("reject_code is null"), engine).select("path", F.col("reject_code").alias("_code"))
    both = files.join(passed, "path", "left")
    return both.withColumn("reason", F.coalesce("reason", F.when(F.col("_code").isNotNull(), "pages"))).withColumn("reject_code", F.coalesce("reject_code", "_code")).drop("_code")


def _told(files: DataFrame, rules: list) -> DataFrame:
    code, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for broken, c, r in reversed(rules):
        code, reason = F.when(broken, c).otherwise(code), F.when(broken, r).otherwise(reason)
    return files.withColumn("reject_code", code).withColumn("reason", reason)


def _is_word(extension: str, content: bytes) -> bool:
    if extension == "doc":
        return content.startswith(OLD_WORD)
    try:
        return ZIP_PARTS[extension] in zipfile.ZipFile(io.BytesIO(content)).namelist()
    except (zipfile.BadZipFile, ValueError, EOFError):
        return False


def check_word(files: DataFrame, structure: bool = True) -> DataFrame:
    """Files with ``reject_code``, ``reason`` and ``content_type``: name, size and emptiness; with ``structure`` a zip's
    directory must name the document, and an old file begin as such."""
    ship(files.sparkSession)
    known = F.create_map(*[F.lit(x) for kv in WORD_TYPES.items() for x in kv])
    files = files.withColumn("content_type", F.element_at(known, _extension()))
    rules = [(F.col("content_type").isNull(), EMPTY, "extension"), (F.col("length") > MAX_BYTES, EMPTY, "too_large"), (F.col("length") == 0, EMPTY, "empty")]
    files = _told(files, rules)
    if not structure:
        return files

    def body(batches):
        for b in batches:
            good = [_is_word(e, bytes(c)) for e, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(good, pa.bool_())], names=["path", "_good"])

    looked = files.filter("reject_code is null").select("path", _extension().alias("extension"), "content").mapInArrow(body, "path string, _good boolean")
    both = files.join(looked, "path", "left")
    broken = ~F.coalesce("_good", F.lit(True))
    return both.withColumn("reject_code", F.when(broken, NOT_SUPPORTED).otherwise(F.col("reject_code"))).withColumn("reason", F.when(broken, "not_a_document").otherwise(F.col("reason"))).drop("_good")


def write_batch(checked: DataFrame, batch: int, target: str) -> None:
    """Good files under ``good/batch=n`` with their digest, refused ones without their bytes under ``quarantine/batch=n``.

    Both are overwritten, so a batch that is run again adds nothing.
    """
    checked = checked.withColumn("sha256", F.sha2("content", 256))
    good, refused = checked.filter("reject_code is null"), checked.filter("reject_code is not null").drop("content")
    good.drop("reject_code", "reason").write.mode("overwrite").parquet(f"{target}/good/batch={batch}")
    refused.write.mode("overwrite").parquet(f"{target}/quarantine/batch={batch}")


def ingest(spark: SparkSession, folder: str, target: str, check=check_pdfs, files_per_batch: int = 100):
    """A running query that takes new files of ``folder`` in batches, checks them and writes both tables.

    Files of no bytes never come: Spark's reader passes over them. Which files a batch has is in the checkpoint; started again it goes on with the batch that was not finished.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = source.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder)
    write = files.writeStream.foreachBatch(lambda df, n: write_batch(check(df), n, target))
    return write.option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
