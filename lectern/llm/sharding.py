"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on a ring of 2^60 places at ``virtual_nodes`` hashed places. A row's place is a hash of its text, its
turn another hash of the same text (equal texts: by key). Rows are taken in turn: each goes to the first shard clockwise
of its place that is not full. A shard is full when its load has reached its capacity, so the load of the law ``rows``
differs by one row at most, and that of ``bytes`` passes the mean by less than one row. Equal texts lie together: of all
groups of equal texts only those in whose turn a shard fills, or that exceed a shard, are parted. A changed number of
shards moves the rows of the changed arcs and those that overflow differently, no others.

On Spark: which shards are full changes at most once a shard, so the taking in turn is no loop over rows. Rows are
range-sorted by turn once; loads of (interval of turns, arc) tell in which interval the next shard fills, that interval is
counted more finely, and its last few thousand rows are looked at one by one. What reaches the driver is bounded by
``BINS`` x arcs of the ring, whatever the number of rows. Between two such points every arc has one shard, so a broadcast
table of (shards + 1) x arcs rows places all rows at once.

Defined cases: a null text counts as empty, in the hash and with no bytes; null keys come first among equal texts; repeated
rows are alike and interchangeable, each has a slot of its own; an empty table gives an empty result; with fewer rows than
shards some shards are empty; all columns are kept inside a struct while rows are placed, so names cannot clash, and an
input column called ``shard`` or ``slot`` is replaced.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, in_order, materialise, ship, table

#: Hex digits of a place on the ring, and the places.
DIGITS, PLACES = 15, 1 << 60
SHARDS, VIRTUAL_NODES = 16, 64
#: Intervals of one count, and rows below which an interval is walked row by row.
BINS, WALKED = 256, 4096


def _place(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of all virtual nodes; for each, all shards in the order in which they are met clockwise from it."""
    nodes = sorted((_place(f"{s}:{v}"), s) for s in range(shards) for v in range(virtual_nodes))
    around = [s for _, s in nodes] * 2
    walks = [list(dict.fromkeys(around[i : i + len(nodes)])) for i in range(len(nodes))]
    return np.array([p for p, _ in nodes], dtype=np.int64), np.array(walks, dtype=np.int64)


class _Fill:
    """Loads of the shards as rows are taken in turn, and the points at which arcs change their shard."""

    def __init__(self, walks: np.ndarray, capacity: np.ndarray):
        self.walks, self.capacity, self.load = walks, capacity, np.zeros(len(capacity), dtype=np.int64)
        self.points: list[tuple[int, np.ndarray]] = []
        self.change(0)

    def change(self, turn: int) -> None:
        full = self.load >= self.capacity
        first = np.argmin(full[self.walks], axis=1)
        self.owner = self.walks[np.arange(len(self.walks)), first]
        self.points.append((turn, self.owner))

    def take(self, arcs: np.ndarray, weights: np.ndarray) -> bool:
        """Take all rows of an interval, unless a shard fills in it."""
        load = self.load + np.bincount(self.owner[arcs], weights, minlength=len(self.load)).astype(np.int64)
        if ((load >= self.capacity) & (self.load < self.capacity)).any():
            return False
        self.load = load
        return True


def _walk(ranked: DataFrame, start: int, end: int, fill: _Fill) -> None:
    """Take the rows of turns ``start`` to ``end``, finer where a shard fills."""
    within = ranked.filter((F.col("turn") >= start) & (F.col("turn") < end))
    if end - start <= WALKED:
        rows = within.select("turn", "arc", "weight").toPandas().sort_values("turn")
        for turn, arc, weight in rows.itertuples(index=False):
            shard = fill.owner[arc]
            fill.load[shard] += weight
            if fill.load[shard] >= fill.capacity[shard]:
                fill.change(turn + 1)
        return
    width = -(-(end - start) // BINS)
    bins = within.groupBy(F.floor((F.col("turn") - start) / width).cast("int").alias("bin"), "arc").agg(F.sum("weight").alias("weight")).toPandas()
    for b, rows in bins.groupby("bin"):
        if not fill.take(rows["arc"].to_numpy(), rows["weight"].to_numpy()):
            _walk(ranked, start + b * width, min(end, start + (b + 1) * width), fill)


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """``turn``, from 0, for rows that carry ``_at``; the number of rows. The driver gets one count a partition."""
    part = F.shiftright("_at", 33)
    counts = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for c in counts:
        before.append((c["part"], total))
        total += c["n"]
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "part long, before long")
    rows = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return rows.withColumn("turn", F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("before", "_at"), total


def shard_rows(rows: DataFrame, text: Column, key: Column, weight: Column | None = None, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the place within the shard, gapless from 0.

    Without ``weight`` the law is ``rows`` (counts at most one apart), with it loads of that weight (a long above 0).
    """
    ship(rows.sparkSession)
    places, walks = ring(shards, virtual_nodes)

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(places, place.to_numpy()) % len(places)).astype(np.int32))

    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    part_of = lambda k: F.conv(F.substring("digest", 1 + k * (DIGITS + 1), DIGITS), 16, 10).cast("long")
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]).alias("row")
    keyed = rows.select(whole, key.alias("key"), F.lit(1).cast("long").alias("weight") if weight is None else weight.alias("weight"), digest.alias("digest"))
    keyed = keyed.select("row", "key", "weight", part_of(0).alias("place"), part_of(1).alias("order")).withColumn("arc", arc_of("place"))
    written = materialise(in_order(keyed.drop("place"), "order", "key"))
    ranked, n = _numbered(written)
    capacity = np.array([n // shards + (s < n % shards) for s in range(shards)], dtype=np.int64)
    if weight is not None:
        total = ranked.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
        capacity = np.full(shards, -(-total // shards), dtype=np.int64)
    fill = _Fill(walks, capacity)
    _walk(ranked, 0, n, fill)
    owners = [(e, a, int(s)) for e, (_, owner) in enumerate(fill.points) for a, s in enumerate(owner)]
    owners = rows.sparkSession.createDataFrame(pd.DataFrame(owners, columns=["epoch", "arc", "shard"]), "epoch int, arc int, shard int")
    epoch = reduce(lambda x, t: x + (F.col("turn") >= t).cast("int"), [t for t, _ in fill.points[1:]], F.lit(0))
    placed = ranked.withColumn("epoch", epoch).join(F.broadcast(owners), ["epoch", "arc"]).select("row", "part", "turn", "shard")
    parts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("turn")) - 1
    out = placed.withColumn("within", within).join(parts.select("shard", "part", before.alias("before")), ["shard", "part"])
    out = materialise(out.select("row.*", "shard", (F.col("before") + F.col("within")).alias("slot")))
    discard(written)
    return out


def shard_documents(docs: DataFrame, law: str = "rows", shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Documents with ``shard`` and ``slot`` under the law ``rows`` or ``bytes`` (UTF-8 bytes of the text plus 1)."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law}")
    return shard_rows(docs, F.col("text"), F.col("doc_id"), text_size() if law == "bytes" else None, shards, virtual_nodes)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, ``shard=0`` and so on, its rows in order of ``slot`` over as many files as the shard needs."""
    ranges = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranges.write.partitionBy("shard").parquet(path)


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    """The law is ``rows``."""
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", text_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    placed = shard_rows(narrow, F.col("text_md5"), F.col("doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


#: The 256 steps of crc32 over a byte, and crc32 of a list of bytes by that table ``steps``.
CRC32_STEPS_SQL = "list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))"
CRC32_SQL = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"
_HEX = "('0x' || substr({}, {}, 15))::BIGINT"
_CHOSEN = f"list_filter(walk, lambda x: state[x + 1] < n // {SHARDS} + CASE WHEN x < n % {SHARDS} THEN 1 ELSE 0 END)[1]"
OP12_SQL = f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS text, md5(md5(coalesce(text, ''))) AS m FROM documents),
d AS (
  SELECT doc_id, strlen(text) + 1 AS size, encode(text) AS e, {_HEX.format("m", 1)} AS place,
         row_number() OVER (ORDER BY {_HEX.format("m", 17)}, doc_id NULLS FIRST) AS turn FROM b),
nodes AS (
  SELECT s, {_HEX.format("md5(s || ':' || v)", 1)} AS spot FROM (SELECT unnest(range({SHARDS})) AS s), (SELECT unnest(range({VIRTUAL_NODES})) AS v)),
near AS (SELECT turn, s, min((spot - place + {PLACES}) % {PLACES}) AS away FROM d, nodes GROUP BY turn, s),
walks AS (SELECT turn, list(s ORDER BY away) AS walk FROM near GROUP BY turn),
total AS (SELECT count(*) AS n FROM d),
states AS (  -- loads of the shards, then the shard of every row so far
  SELECT list_reduce(list_concat([list_resize([]::BIGINT[], {SHARDS}, 0)], (SELECT list(walk ORDER BY turn) FROM walks)),
           lambda state, walk: list_concat(
             list_transform(range({SHARDS}), lambda s: state[s + 1] + ({_CHOSEN} = s)::BIGINT),
             state[{SHARDS} + 1:], [{_CHOSEN}])) AS state
  FROM total),
taken AS (SELECT unnest(range(1, len(state) - {SHARDS} + 1)) AS turn, unnest(state[{SHARDS} + 1:]) AS shard FROM states),
crc AS (
  SELECT turn, text_crc32 FROM (
    SELECT turn, {CRC32_SQL.format(bytes="list_transform(range(strlen(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)")} AS text_crc32
    FROM (SELECT turn, hex(e) AS h FROM d), (SELECT {CRC32_STEPS_SQL} AS steps)))
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY turn) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN taken USING (turn) JOIN crc USING (turn)
"""
