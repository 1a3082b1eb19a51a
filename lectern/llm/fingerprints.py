"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks possible boundaries; below the normal chunk length a stricter mask must
match, above it a looser one (normalised chunking). A fingerprint is the sorted set of distinct chunks, each as a
digest with its length, and likeness is the shared length over the smaller of two total lengths (containment).

Defined cases: null and empty texts have the empty fingerprint, alike (1) to each other and unlike (0) to any
other; equal texts have equal fingerprints; a document alone is its own next document; rows with one ``doc_id``
follow one another by the md5 of their texts, alike ones in any order; a null ``doc_id`` comes last; an empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_stream, bounded_batches, materialise, table

LEAST, NORMAL, MOST = 16, 48, 256
STRICT, LOOSE = np.uint32(0x7F << 25), np.uint32(0x1F << 27)
GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Characters of a range of the next-document step, on average, and the most ranges: beyond that they hold more.
RANGE_BYTES, MOST_RANGES = 16_000_000, 200_000


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum over the last 32 bytes of table entries shifted by their age."""
    h, k = GEAR[data], 1
    while k < 32:
        shifted = h.copy()
        shifted[k:] += h[:-k] << np.uint32(k) if len(h) > k else 0
        h, k = shifted, 2 * k
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Chunk ends of a byte string."""
    n, out, start = len(data), [], 0
    h = gear_hashes(data)
    strict, loose = np.flatnonzero(h & STRICT == 0) + 1, np.flatnonzero(h & LOOSE == 0) + 1
    strict, loose = strict.tolist() + [n + MOST], loose.tolist() + [n + MOST]
    i = j = 0
    while n - start > LEAST:
        while strict[i] < start + LEAST:
            i += 1
        end = strict[i]
        if end > start + NORMAL:
            while loose[j] < start + NORMAL:
                j += 1
            end = min(loose[j], start + MOST)
        if end >= n:
            break
        out.append(end)
        start = end
    if n > start:
        out.append(n)
    return out


def fingerprint(text: str) -> dict[bytes, int]:
    """Distinct chunk digests (6 bytes) with their lengths."""
    raw = text.encode()
    start, out = 0, {}
    blake = hashlib.blake2b
    for end in boundaries(np.frombuffer(raw, np.uint8)) if raw else ():
        out[blake(raw[start:end], digest_size=6).digest()] = end - start
        start = end
    return out


def as_text(chunks: dict[bytes, int]) -> str:
    """Sixteen hex digits a chunk: digest, then length."""
    return "".join(sorted(f"{d.hex()}{n:04x}" for d, n in chunks.items()))


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    return sum(n for d, n in a.items() if d in b) / min(sum(a.values()), sum(b.values()))


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def range_of(cuts: np.ndarray, parts_of_null: int):
    """A pandas UDF from (doc_id, digest) to the number of a range.

    ``cuts`` are sorted; an id that occurs in them k times has k ranges, by the digest from 0 to 2 ** 32. The ids below the
    first cut have range 0, those from a cut on the range after it, null ids the last ``parts_of_null`` ones.
    """
    first, last = np.searchsorted(cuts, cuts, "left"), np.searchsorted(cuts, cuts, "right")

    @F.pandas_udf("int")
    def number(ids: pd.Series, digests: pd.Series) -> pd.Series:
        null, share = ids.isna().to_numpy(), digests.to_numpy(dtype=np.float64) / 2**32
        keys = ids.fillna(0).to_numpy(dtype=np.int64)
        place = np.searchsorted(cuts, keys, "right")
        if len(cuts):
            at = np.maximum(place - 1, 0)
            hot = cuts[at] == keys
            place = np.where(hot, first[at] + 1 + (share * (last[at] - first[at])).astype(np.int64), place)
        return pd.Series(np.where(null, len(cuts) + 1 + (share * parts_of_null).astype(np.int64), place).astype(np.int32))

    return number


def with_next(docs: DataFrame, fn, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Apply ``fn(doc_id, text, next text, state)`` to every document in ascending order of ``doc_id``, round the end.

    Rows are dealt once into ranges of ids of about equal counts; the first document of each range is sent to the
    range before it as well. An id with many rows, null included, gets several ranges by text. The driver holds no more
    than the bounds of the ranges; the first documents are a table that the plan joins, so no term of it grows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    n, nulls, size = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    ranges = max(1, min(n, size // range_bytes + 1, MOST_RANGES))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = np.array(sorted(int(c) for c in docs.stat.approxQuantile("doc_id", shares, 0.2 / ranges)) if shares and n > nulls else [], np.int64)
    number = range_of(cuts, max(1, round(ranges * nulls / max(1, n))))
    docs = docs.withColumn("bucket", number("doc_id", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")))
    # The least (doc_id, digest) of each range is the document that the range before it ends on; one row a range.
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    firsts = materialise(docs.drop("text").groupBy("bucket").agg(F.min(order).alias("first")).select("bucket", "first.doc_id", "first.digest"))
    before = F.lag("bucket").over(Window.orderBy("bucket"))
    last = firsts.agg(F.max("bucket")).first()[0]
    to = firsts.select(F.col("doc_id").alias("first_id"), F.col("digest").alias("first_digest"), F.coalesce(before, F.lit(last)).alias("to"))
    marked = docs.join(F.broadcast(to), docs["doc_id"].eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    home, visit = F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(F.col("to").isNull(), F.array(home)).otherwise(F.array(home, visit))
    dealt = marked.withColumn("place", F.explode(places)).select("doc_id", "text", "digest", "place.bucket", "place.guest")
    dealt = dealt.repartition(ranges, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "digest")

    def body(batches):
        held, state, seen = None, {}, None
        for columns in batches:
            rows = []
            for i, t, b, guest in zip(*(c.to_pylist() for c in columns)):
                if held is not None and held[2] == b:
                    rows.append(fn(held[0], held[1], t or "", state))
                if b != seen:
                    held = None
                if not guest:
                    held, seen = (i, t or "", b), b
                else:  # copies of the first document may come as guests too: one is enough
                    held = None
            if rows:
                yield list(map(list, zip(*rows)))

    body.__module__ = fn.__module__
    return arrow_stream(dealt, body, schema, "doc_id", "text", "bucket", "guest")


def _fingerprint_row(doc_id, text: str, following: str, state: dict) -> tuple:
    own = state.pop("next", None)
    own = own[1] if own and own[0] == text else fingerprint(text)
    after = fingerprint(following)
    state["next"] = (following, after)
    edited = edited_text(text, following)
    marks = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(marks), likeness(own, marks), likeness(own, after)


FINGERPRINT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return with_next(docs, _fingerprint_row, FINGERPRINT_SCHEMA)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
