"""The trie of conversation prefixes, by Patricia construction.

Turns are range-sorted by conversation and place; a prefix of a conversation is known by its length and the exclusive-or of
the digests of its (place, role, text), which is a running aggregate, so no conversation is gathered: a conversation that
lies over several partitions of the sort gets its prefixes part by part, from carried totals. Conversations with equal
turns are one sequence from there on, held by the least conv_id. Then

1. points: only prefixes that branch, end or are leaves stay; all others (unary) fall out,
2. edges: each point is tied to the next point above it by a window over the points of one conversation. Going down, the
   least member changes only below a branch, so the points with one least member form a chain,
3. aggregates over compressed edges: an edge saves (members - 1) x words of all its turns, by prefix sums of words. A point
   has what lies below it on its own chain (suffix sums over the chain's points) and the totals of all chains that leave
   at or below it, which every conversation adds to the points of other chains that it passes,
4. expansion: each edge gives back its unary nodes, whose saving is that of its lower point plus the edge's suffix sum.

The list of members that end at a node is hashed in order by a stream over packed runs of ids, never held as a whole; the
runs of one list meet in one task, as SHA-256 cannot be parted.

Defined cases: null role or text is empty; a null turn comes first, ties go by role and text, repeated rows are turns of
their own; rows without a conv_id belong to no conversation and are left out; conversations without turns end at the root;
an empty table gives no node; columns beyond conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map, arrow_stream, crc_mod, discard, in_order, materialise, table, word_count
from .sharding import CRC32_SQL, CRC32_STEPS_SQL

#: Turns of an edge that are expanded by one row.
RUN = 4096
FAMILY, MOST_SHARED = 20, 4
KEY = ("d", "hi", "lo")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def own_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, _at, role, text) in a written table, and (conv_id, part, first, before, n) of each conversation
    in each partition of the sort: a row's place is ``_at - first + before``, from 0."""
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialise(in_order(rows, "conv_id", "turn", "role", "text").withColumn("part", F.shiftright("_at", 33)).drop("turn"))
    spans = rows.groupBy("conv_id", "part").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(turns, conversations, written tables) for ``prefix_trie``: every conversation as it is."""
    rows, spans = own_turns(conversations)
    turns = rows.join(spans, ["conv_id", "part"]).select("conv_id", F.col("part").alias("block"), (F.col("_at") - F.col("first") + F.col("before") + 1).alias("d"), "role", "text")
    return turns, rows.select("conv_id").distinct(), [rows]


def rebuilt(conversations: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """As ``plain``, with the first h turns of each conversation replaced by those of the first of its family, where
    h is crc32(conv_id) modulo ``most_shared`` and a family is ``family`` ids in a row."""
    rows, spans = own_turns(conversations)
    spans = materialise(spans)
    shared = crc_mod(F.col("conv_id"), most_shared)
    known = spans.groupBy("conv_id").agg(F.sum("n").alias("n"))
    members = known.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("head"), shared.alias("h"))
    members = members.join(known.select(F.col("conv_id").alias("head"), F.col("n").alias("there")), "head", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    spans_of = spans.join(members.select("conv_id", "h", "taken"), "conv_id")
    place = F.col("_at") - F.col("first") + F.col("before")
    own = rows.join(spans_of, ["conv_id", "part"]).filter(place >= F.col("h"))
    own = own.select("conv_id", F.col("part").alias("block"), (F.col("taken") + place - F.col("h") + 1).alias("d"), "role", "text")
    first = spans.filter(F.col("before") < most_shared - 1).select("conv_id", "part", "first", "before")
    heads = rows.filter(F.col("conv_id") % family == 0).join(first, ["conv_id", "part"]).filter(place < most_shared - 1)
    heads = heads.select(F.col("conv_id").alias("head"), (place + 1).alias("d"), "role", "text")
    lent = members.join(heads, "head").filter("d <= h").select("conv_id", F.lit(-1).cast("long").alias("block"), "d", "role", "text")
    return own.unionByName(lent), members.select("conv_id"), [rows, spans]


def _runs(conv, d, hi, lo):
    """One row for each run of equal keys in a batch: key, least id, number, ids joined."""
    ids, key = conv.to_numpy(), np.stack([x.to_numpy() for x in (d, hi, lo)])
    at = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]) if len(ids) else np.zeros(0, dtype=np.int64)
    ends = np.append(at[1:], len(ids))
    return [*(k[at] for k in key), ids[at], ends - at, [",".join(map(str, ids[s:e].tolist())) for s, e in zip(at, ends)]]


def _hashed(batches):
    """Runs in order of key and id to one row a key: key, least id, number of ids, SHA-256 of all ids joined."""
    key = None
    for columns in batches:
        done = []
        for *now, first, n, ids in zip(*(c.to_pylist() for c in columns)):
            if now != key:
                if key is not None:
                    done.append((*key, least, count, digest.hexdigest()))
                key, least, count, digest = now, first, 0, hashlib.sha256()
            digest.update((("," if count else "") + ids).encode())
            count += n
        yield list(zip(*done)) if done else [[]] * 6
    if key is not None:
        yield list(zip(*[(*key, least, count, digest.hexdigest())]))


def ends_of(convs: DataFrame) -> DataFrame:
    """(d, hi, lo, rep, n_ends, sha) for (conv_id, d, hi, lo): the conversations that end at each prefix."""
    ranged = convs.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    runs = arrow_map(ranged, _runs, "d long, hi long, lo long, first long, n long, ids string", "conv_id", *KEY)
    met = runs.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return arrow_stream(met, _hashed, "d long, hi long, lo long, rep long, n_ends long, sha string", *KEY, "first", "n", "ids")


def _half(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node.

    ``turns`` has conv_id, d (1, 2, ... without gaps), block (rising with d), role, text; ``convs`` all conv_id, each once.
    """
    digest = F.sha2(F.concat(F.col("d"), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"), 256)
    turns = turns.select("conv_id", "block", "d", word_count(F.col("text")).alias("w"), digest.alias("x"))
    turns = materialise(turns.select("conv_id", "block", "d", "w", _half(F.col("x"), 0).alias("x_hi"), _half(F.col("x"), 1).alias("x_lo")))
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.bit_xor("x_hi").alias("hi"), F.bit_xor("x_lo").alias("lo"), F.sum("w").alias("w"))
    whole = convs.join(blocks.groupBy("conv_id").agg(F.sum("n").alias("d"), F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo")), "conv_id", "left").na.fill(0, list(KEY))
    ends = materialise(ends_of(whole))

    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"{c}_0") for f, c in ((F.bit_xor, "hi"), (F.bit_xor, "lo"), (F.sum, "w"))]
    held = blocks.select("conv_id", "block", *carried).join(ends.select(F.col("rep").alias("conv_id"), F.col("d").alias("length"), "n_ends"), "conv_id")
    so_far = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.join(held, ["conv_id", "block"])
    rows = rows.withColumn("hi", F.bit_xor("x_hi").over(so_far).bitwiseXOR(F.col("hi_0"))).withColumn("lo", F.bit_xor("x_lo").over(so_far).bitwiseXOR(F.col("lo_0")))
    rows = rows.withColumn("words", F.sum("w").over(so_far) + F.col("w_0"))  # of all turns up to this one
    rows = materialise(rows.select("conv_id", *KEY, F.col("hi").bitwiseXOR(F.col("x_hi")).alias("up_hi"), F.col("lo").bitwiseXOR(F.col("x_lo")).alias("up_lo"), "w", "words", F.col("n_ends").alias("same"), "length"))

    prefixes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.sum("same").alias("n"), F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"))
    ways = prefixes.groupBy((F.col("d") - 1).alias("d"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    none = F.lit(None).cast("string").alias("sha")
    marks = ways.select(*KEY, "n_children", F.lit(0).alias("n_ends"), none).unionByName(ends.select(*KEY, F.lit(0).alias("n_children"), "n_ends", "sha"))
    marks = materialise(marks.groupBy(*KEY).agg(F.sum("n_children").alias("n_children"), F.sum("n_ends").alias("n_ends"), F.coalesce(F.max("sha"), F.lit(EMPTY_SHA)).alias("sha")).filter("n_children <> 1 or n_ends > 0 or d = 0"))
    points = marks.filter("d > 0").drop("n_ends").join(prefixes.select(*KEY, "rep", "n"), list(KEY))

    path = Window.partitionBy("conv_id").orderBy("d")
    below = path.rowsBetween(1, Window.unboundedFollowing)
    passed = rows.select("conv_id", *KEY, "w", "words", "length").join(points, list(KEY))
    own, leaf = F.col("rep") == F.col("conv_id"), ((F.col("d") == F.col("length")) & (F.col("n_children") == 0)).cast("long")
    passed = passed.withColumn("up_d", F.coalesce(F.lag("d").over(path), F.lit(0))).withColumn("up_words", F.coalesce(F.lag("words").over(path), F.lit(0))).withColumn("up_rep", F.lag("rep").over(path))
    passed = passed.withColumn("edge", F.when(own, (F.col("n") - 1) * (F.col("words") - F.col("up_words"))).otherwise(0))
    chain = Window.partitionBy("conv_id")
    passed = passed.withColumn("total", F.sum("edge").over(chain)).withColumn("leaf", F.max(leaf).over(chain)).withColumn("under", F.coalesce(F.sum("edge").over(below), F.lit(0)))
    saved = F.when(own, (F.col("n") - 1) * F.col("w") + F.col("under")).otherwise(F.col("total"))
    mine = F.when(own, F.struct("up_d", "up_rep", "words", "w", "edge"))
    points = materialise(passed.groupBy(*KEY, "rep", "n", "n_children", "sha").agg(F.sum(saved).alias("saved"), F.sum("leaf").alias("n_leaves"), F.max(mine).alias("m")).select("d", "rep", "n", "n_children", "sha", "saved", "n_leaves", "m.*"))

    out = materialise(_expanded(points, rows, _root(convs, marks, points)))
    discard(turns, ends, rows, marks, points)
    return out


def _root(convs: DataFrame, marks: DataFrame, points: DataFrame) -> dict:
    """The root's values; a point whose least member is the conversation's own holds that chain's savings."""
    n, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    mark = marks.filter("d = 0").first()
    saved, leaves = points.agg(F.coalesce(F.sum("edge"), F.lit(0)), F.coalesce(F.sum((F.col("n_children") == 0).cast("long")), F.lit(0))).first()
    return {"n": n, "rep": least, "n_children": mark["n_children"] if mark else 0, "sha": mark["sha"] if mark else EMPTY_SHA, "saved": saved, "n_leaves": leaves or 1}


def _expanded(points: DataFrame, rows: DataFrame, root: dict) -> DataFrame:
    """All nodes: the root, the points, and the unary nodes of every edge."""
    up_rep = F.coalesce("up_rep", F.lit(root["rep"]).cast("long"))
    parent = F.when(F.col("depth") == F.col("up_d") + 1, up_rep).otherwise(F.col("rep"))

    def node(df: DataFrame, n_children: Column, saved: Column, sha: Column) -> DataFrame:
        return df.select(F.col("rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), n_children.alias("n_children"), "n_leaves", saved.alias("saved_tokens"), sha.alias("ends_sha256"))

    own = node(points.withColumn("depth", F.col("d")), F.col("n_children"), F.col("saved"), F.col("sha"))
    runs = points.filter("d - up_d > 1").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("d") - F.col("up_d") - 2) / RUN))))
    start = F.col("up_d") + 1 + F.col("run") * RUN
    unary = runs.withColumn("depth", F.explode(F.sequence(start, F.least(start + RUN - 1, F.col("d") - 1))))
    lower = F.col("words") - F.col("w")
    unary = unary.withColumn("lower", lower).drop("words", "w").join(rows.select(F.col("conv_id").alias("rep"), F.col("d").alias("depth"), (F.col("words") - F.col("w")).alias("upper")), ["rep", "depth"])
    unary = node(unary, F.lit(1).cast("long"), F.col("saved") + (F.col("n") - 1) * (F.col("lower") - F.col("upper")), F.lit(EMPTY_SHA))
    top = [(root["rep"], 0, None, root["n"], root["n_children"], root["n_leaves"], root["saved"], root["sha"])] if root["n"] else []
    return own.unionByName(unary).unionByName(points.sparkSession.createDataFrame(top, own.schema))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns, convs, written = plain(conversations)
    out = prefix_trie(turns, convs)
    discard(*written)
    return out


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns, convs, written = rebuilt(table(spark, sf_dir, "conversations"))
    out = prefix_trie(turns, convs)
    discard(*written)
    return out


_WORD = r"[^\x20\x09-\x0D]+"
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS head,
         {CRC32_SQL.format(bytes="list_transform(range(len(conv_id::VARCHAR)), lambda i: unicode(substr(conv_id::VARCHAR, i + 1, 1)))")} % {MOST_SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM t), (SELECT {CRC32_STEPS_SQL} AS steps)),
r AS (
  SELECT c.conv_id, 0 AS own, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.head AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t USING (conv_id) WHERE t.place > c.h),
s AS (
  SELECT c.conv_id, coalesce(list(struct_pack(role, text) ORDER BY own, place) FILTER (own IS NOT NULL), []) AS s
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM s),
n AS (
  SELECT s[:depth] AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '') AS ends
  FROM p GROUP BY s[:depth], depth),
k AS (SELECT key[:depth - 1] AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY key[:depth - 1]),
a AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(key[depth].text, '{_WORD}')) END AS saved
  FROM n LEFT JOIN k ON k.up = n.key),
u AS (
  SELECT key[:top] AS up, sum(saved) AS saved_tokens, sum((n_children = 0)::BIGINT) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS top FROM a) GROUP BY key[:top])
SELECT a.conv_id, a.depth, q.conv_id AS parent_conv_id, a.n_convs, a.n_children, u.n_leaves::BIGINT AS n_leaves,
       u.saved_tokens::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN u ON u.up = a.key LEFT JOIN a q ON a.depth > 0 AND q.key = a.key[:a.depth - 1]
"""
