"""Phrase collocation mining by contiguous pattern growth, after PrefixSpan.

1. Words are counted by language, exactly and as words; from here on a word is the 64-bit xxhash of (language, word).
2. Every occurrence of a frequent word that a frequent word follows is projected: its pointer names the next words of its
   piece, up to ``max_words``, and ends before the first rare one. Equal pointers of a chunk of text are one, with a count.
3. Pointers are dealt by their two-word prefix, as one word alone may begin a large share of all phrases. A task takes its
   prefixes one after another: it sorts a prefix's pointers and grows every frequent phrase to the right, depth first,
   each longer phrase within the range of pointers of the one before. Equal pointers from many chunks are merged on the way.
4. Parts of a phrase are looked up by joins for its scores, and longer phrases tell the ones inside them their counts.

Scores are exact: products are decimals of 38 digits, quotients are floored. Two of a corpus' frequent words have one hash
with probability of about (frequent words)^2 / 2^65; nothing else is approximate.

Defined cases: a null text is empty, a null language ``und``; texts without words and empty tables give no phrase;
repeated rows count as often as they occur; ties in rank go by count and then by the phrase's bytes; columns beyond lang
and text are ignored, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import UPPER, arrow_stream, bitmap_of, bitmap_size, discard, in_bitmap, materialise, table, texts_of

MAX_WORDS, LEAST_COUNT, COVERED, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
#: Bytes of text that a worker takes at once, pointers of one task's turn on average, and beyond which they are merged.
CHUNK, BUCKET, MERGE = 8 << 20, 1_000_000, 4_000_000
#: Parts of a language in the first of two rankings.
SALTS = 64

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_KIND = np.zeros(256, dtype=np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def _words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words in order, and whether each is followed by another of its piece."""
    raw = np.frombuffer("\n".join(texts).encode().translate(_LOWER), dtype=np.uint8)
    kind = _KIND[raw]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[kind == 0]))
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    return words.dictionary_encode(), np.append(piece[1:] == piece[:-1], False) if len(starts) else np.zeros(0, dtype=bool)


def _chunks(batches):
    """(language, words, followed) for a few megabytes of text of one language at a time."""
    held: dict[str, list[str]] = {}
    size = 0
    for langs, texts in batches:
        for lang, text in zip(langs.to_pylist(), texts_of(texts)):
            held.setdefault(lang, []).append(text)
            size += len(text)
        if size >= CHUNK:
            yield from ((lang, *_words(t)) for lang, t in held.items())
            held, size = {}, 0
    yield from ((lang, *_words(t)) for lang, t in held.items())


def _counted(batches):
    for lang, words, _ in _chunks(batches):
        n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        yield [[lang] * len(n), words.dictionary, n]


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first ^ (second << np.uint64(31) | second >> np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _distinct(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of values below ``base``, with their numbers."""
    if base ** len(columns) >= 1 << 63:
        rows, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return list(rows.T), n
    x = columns[0]
    for c in columns[1:]:
        x = x * base + c
    x, n = np.unique(x, return_counts=True)
    out = []
    for _ in columns:
        x, c = np.divmod(x, base)
        out.append(c)
    return out[::-1], n


def _projected(batches, frequent, buckets: int, max_words: int):
    """Pointers by language and bucket of their first two words: columns of hashes, 0 for none, then counts, compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for lang, words, followed in _chunks(batches):
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        keys = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(words.dictionary))
        known = in_bitmap(frequent.value, keys)
        local = np.where(known, np.cumsum(known), 0)  # 0: rare or none
        code = local[words.indices.to_numpy()]
        code, followed = np.append(code, np.zeros(max_words, dtype=np.int64)), np.append(followed, np.zeros(max_words, dtype=bool))
        start = np.flatnonzero((code[:-1] > 0) & followed[:-1] & (code[1:] > 0))
        columns, live = [code[start]], np.ones(len(start), dtype=bool)
        for k in range(1, max_words):
            live &= followed[start + k - 1] & (code[start + k] > 0)
            columns.append(np.where(live, code[start + k], 0))
        if not len(start):
            continue
        columns, n = _distinct(columns, int(known.sum()) + 1)
        of = np.concatenate([np.zeros(1, dtype=np.uint64), keys[known]])
        columns = [of[c] for c in columns]
        bucket = (_mixed(columns[0], columns[1]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        columns, n, bucket = [c[order] for c in columns], n[order].astype(np.uint32), bucket[order]
        at = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        ends = np.append(at[1:], len(bucket))
        yield [[lang] * len(at), bucket[at], [pack(b"".join([*(c[s:e].tobytes() for c in columns), n[s:e].tobytes()])) for s, e in zip(at, ends)]]


def _merged(columns: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pointers in order, with summed counts."""
    order = np.lexsort(columns[::-1])
    columns, n = columns[:, order], n[order]
    new = np.concatenate([[True], (columns[:, 1:] != columns[:, :-1]).any(axis=0)])
    return columns[:, new], np.add.reduceat(n, np.flatnonzero(new))


def _grow(columns: np.ndarray, n: np.ndarray, start: int, end: int, k: int, least: int, out: list) -> None:
    """Phrases of k + 1 words and more whose first k words are those of the pointers ``start`` to ``end``, depth first."""
    column = columns[k, start:end]
    at = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
    total = np.add.reduceat(n[start:end], at)
    ends = np.append(at[1:], end - start)
    for i in np.flatnonzero((total >= least) & (column[at] != 0)):
        out.append((columns[: k + 1, start + at[i]], int(total[i])))
        if k + 1 < len(columns):
            _grow(columns, n, start + at[i], start + ends[i], k + 1, least, out)


def _frequent(columns: np.ndarray, n: np.ndarray, least: int) -> list:
    columns, n = _merged(columns, n)
    new = np.concatenate([[True], (columns[:2, 1:] != columns[:2, :-1]).any(axis=0)])  # two-word prefixes
    at = np.flatnonzero(new)
    total, ends, out = np.add.reduceat(n, at), np.append(at[1:], len(n)), []
    for i in np.flatnonzero(total >= least):
        out.append((columns[:2, at[i]], int(total[i])))
        if len(columns) > 2:
            _grow(columns, n, at[i], ends[i], 2, least, out)
    return out


def _mined(batches, max_words: int, least: int):
    """Frequent phrases of two words and more, from pointers in order of language and bucket."""
    unpack = zstandard.ZstdDecompressor().decompress
    now, held, size = None, [], 0

    def joined():
        return np.concatenate([c for c, _ in held], axis=1), np.concatenate([n for _, n in held])

    def done():
        found = _frequent(*joined(), least)
        return [[now[0]] * len(found), [p.view(np.int64).tolist() for p, _ in found], [f for _, f in found]]

    for langs, buckets, packed in batches:
        for lang, bucket, blob in zip(langs.to_pylist(), buckets.to_pylist(), packed.to_pylist()):
            if now != (lang, bucket):
                if held:
                    yield done()
                now, held, size = (lang, bucket), [], 0
            raw = unpack(blob)
            rows = len(raw) // (8 * max_words + 4)
            held.append((np.frombuffer(raw, np.uint64, rows * max_words).reshape(max_words, rows), np.frombuffer(raw, np.uint32, rows, 8 * rows * max_words).astype(np.int64)))
            size += rows
            if size > MERGE:
                held = [_merged(*joined())]
                size = held[0][0].shape[1] // 2  # merged again only after as many new ones
    if held:
        yield done()


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least_count: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: (lang, word, f) of all words; (lang, word, f, key) of the frequent ones; (lang, p, a) of all
    phrases of 2 to ``max_words`` words that occur ``least_count`` times, ``p`` the keys of their words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = materialise(arrow_stream(rows, _counted, "lang string, word string, f long", "lang", "text").groupBy("lang", "word").agg(F.sum("f").alias("f")))
    frequent = materialise(words.filter(F.col("f") >= least_count).withColumn("key", F.xxhash64("lang", "word")))
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    bitmap = spark.sparkContext.broadcast(bitmap_of(frequent, "key", bitmap_size(frequent.count())))
    project = partial(_projected, frequent=bitmap, buckets=max(64, -(-total // BUCKET)), max_words=max_words)
    mine = partial(_mined, max_words=max_words, least=least_count)
    project.__module__ = mine.__module__ = __name__
    pointers = arrow_stream(rows, project, "lang string, bucket long, pointers binary", "lang", "text")
    pointers = pointers.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    phrases = materialise(arrow_stream(pointers, mine, "lang string, p array<long>, a long", "lang", "bucket", "pointers"))
    return words, frequent, phrases


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least_count: int = LEAST_COUNT, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score.

    A phrase inside a longer one that has ``covered`` percent of its count is dropped.
    """
    words, frequent, phrases = phrase_counts(docs, max_words, least_count)
    known = phrases.select("p", F.col("a").alias("f")).unionByName(frequent.select(F.array("key").alias("p"), "f"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    cuts = cuts.withColumn("first", F.slice("p", F.lit(1), F.col("k"))).withColumn("rest", F.slice("p", F.col("k") + 1, F.size("p")))
    cuts = cuts.join(known.select(F.col("p").alias("first"), F.col("f").alias("l")), "first").join(known.select(F.col("p").alias("rest"), F.col("f").alias("r")), "rest")
    wide = lambda c: f"cast({c} as decimal(16,0))"
    score = F.expr(f"{wide('a')} * {wide('a')} * {SCALE} div ({wide('l')} * {wide('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))

    inner = phrases.filter(F.size("p") > 2).withColumn("length", F.explode(F.sequence(F.lit(2), F.size("p") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("p") - F.col("length") + 1))).select(F.slice("p", F.col("at"), F.col("length")).alias("p"), "a")
    inner = inner.groupBy("p").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, "p", "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))

    spelled = kept.select("lang", "p", "a", "s", F.posexplode("p").alias("at", "key")).join(frequent.select("key", "word"), "key")
    spelled = spelled.groupBy("lang", "p", "a", "s").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.select("lang", "a", "s.*", F.array_join(F.col("words.word"), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = spelled.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = materialise(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    discard(words, frequent, phrases)
    return out


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
s AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0a-\\x0d]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM s),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM i, (SELECT unnest(range(1, {MAX_WORDS} + 1)) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
q AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {LEAST_COUNT}),
c AS (
  SELECT q.lang, q.phrase, q.a, cut, x.a AS l, y.a AS r, (q.a::HUGEINT * q.a * {SCALE} // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM q) q
  JOIN f x ON x.lang = q.lang AND x.phrase = array_to_string(q.ws[:cut], ' ')
  JOIN f y ON y.lang = q.lang AND y.phrase = array_to_string(q.ws[cut + 1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM q, (SELECT unnest(range(2, {MAX_WORDS})) AS m), (SELECT unnest(range(1, {MAX_WORDS})) AS i) WHERE m < k AND i + m - 1 <= k
  GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < {COVERED} * b.a
QUALIFY rank <= {TOP}
"""
