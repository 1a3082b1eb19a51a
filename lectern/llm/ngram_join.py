"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

Each text becomes a set of word shingles. Sets of like size form bands; in a band every shingle falls into one of
``m`` segments by hash. Two sets that pass the threshold differ in at most ``H`` shingles. A segment of allowance 0
is indexed by its subset, one of allowance 1 by its subset and its one-deletion neighbourhood too; with
``sum(allowance + 1) = H + 1`` some segment of the two always shares an entry. Segments of allowance 0 may be more
by a spare ``s``: then the two share at least ``s + 1`` entries. The allocation of a band comes from a cost estimate
over the band's counted sets.

An entry of more than ``CROWD`` sets is crowded. In the order of uncrowded before crowded entries, then by hash, two
sets that share ``s + 1`` entries also share one outside the last ``s`` of either (prefix filtering). So

* uncrowded entries give their pairs, counted over all entries: a pair counts when it shares ``s + 1`` entries, less
  the crowded ones that it may share;
* of crowded entries, a set keeps those beyond its spare, which most sets have none of. Each kept entry ties its
  members to one of them (a star), then, while its members are in several components, to others; at last blocks of its
  members are compared, those of different components, in numpy. Nothing is capped and no link between components lost.

A bound on the symmetric difference thins the pairs before they are verified on the whole sets. Within each component
all pairs are then counted, block by block, so that every text has its true number of links.

Sets are told apart by 64-bit hashes of their shingles and words (random ones are alike with a chance of 2 ** -64 a
comparison; words of over ``LONG_WORD`` bytes have a cryptographic digest), and equal sets are one node by a 64-bit key of
the whole set.

Defined cases: a null text or one without words has the empty set and links with nothing, not even its like;
fewer words than the shingle length make one shingle; equal sets link; repeated rows (same ``doc_id``) are each
returned; a null ``doc_id`` counts as larger than any other; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map, arrow_stream, bitmap_of, bitmap_size, discard, in_bitmap, materialise, table, texts_of

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes up to which a word's hash is a polynomial.
LONG_WORD = 64
_POWERS = np.cumprod(np.concatenate([[U(1)], np.full(LONG_WORD, _A, np.uint64)]), dtype=np.uint64)
#: An entry of more sets than this is crowded.
CROWD = 16
#: Spare segments that the cost model may choose, as shares of ``H + 1``.
SPARES = (0.0, 0.08, 0.15, 0.25, 0.4)
#: Entries that a task holds before it sends them on, and that a bucket of the index should hold; bits of an entry.
HELD_ENTRIES, BUCKET_ENTRIES, ENTRY_BITS = 400_000, 600_000, 48
#: Rounds in which entries with several components are tied to one more of their members.
HUB_TURNS = 2
#: Sets and shingles in one block of a component, and columns of the tables by which two blocks are compared.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 256, 1 << 19, 8192
#: Sketches in one block of an entry's members, and rows of a block that are compared at once. A member goes to as many
#: pairs of blocks as its entry has blocks.
BLOCK_SKETCHES, COMPARED = 4096, 128
#: Ratio of a band's bounds, the words of 64 bits in a sketch, and the set size above which sets have a wide one.
BAND, SKETCH, WIDE_FROM = 1.25, 16, 1000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _B
    x = (x ^ (x >> U(27))) * _C
    return x ^ (x >> U(31))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of UTF-8 bytes, A-Z lower-cased, in order, and where each starts.

    Up to ``LONG_WORD`` bytes it is a polynomial over random values of the bytes; such a polynomial modulo 2^64 is alike for
    some longer words whatever its base, so those get a cryptographic digest.
    """
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    total = int(lengths.sum())
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = _BYTE[_LOWER[data[word]]] * _POWERS[np.minimum(place, LONG_WORD)]
    out = _mix(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64) * _C)
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = int.from_bytes(blake2b(_LOWER[data[starts[i] : ends[i]]].astype(np.uint8).tobytes(), digest_size=8).digest(), "little")
    return out, starts


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, in order."""
    return _hashed(np.frombuffer(text.encode(), np.uint8))[0]


def words_of_texts(texts: list[str], at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, one after another, and the number of words of each: many short texts in one pass."""
    hashes, counts, part, size = [], [], [], 0
    for i, t in enumerate(texts):
        part.append(t.encode())
        size += len(part[-1])
        if size >= at_once or i == len(texts) - 1:
            h, starts = _hashed(np.frombuffer(b"\n".join(part), np.uint8))
            ends = np.cumsum([len(x) + 1 for x in part])  # each text and the line break after it
            hashes.append(h), counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
            part, size = [], 0
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * _A + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h + U(k)))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a whole set."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of 1024 hashed buckets: two sets differ in at least as many shingles as their sketches in bits."""
    bits = np.bincount((shingles & U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(shingles: np.ndarray) -> bytes | None:
    """Parities of a power of two of buckets, at least one a shingle, for sets that crowd the short sketch."""
    if len(shingles) <= WIDE_FROM:
        return None
    m = 1 << (len(shingles) - 1).bit_length()
    bits = np.bincount((_mix(shingles) & U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def wide_distance(x: bytes, y: bytes) -> int:
    """Differing parities of two wide sketches, the larger folded to the smaller."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


class Threshold:
    """Jaccard at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def passes(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def least_partner(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def difference(self, total: int) -> int:
        """Most shingles in which two passing sets of ``total`` shingles together can differ."""
        return total - 2 * -(-self.num * total // (self.num + self.den))

    def band_difference(self, top: int) -> int:
        """The same over all pairs whose larger set has at most ``top`` shingles."""
        return max(self.difference(t) for t in range(max(2, 2 * top - 60), 2 * top + 1))


class Band:
    """Sets that can be in a pair whose larger set has ``low`` to ``high - 1`` shingles, and its allocation."""

    def __init__(self, index: int, low: int, high: int, limit: Threshold):
        self.index, self.low, self.high = index, low, high
        self.least, self.most_apart = limit.least_partner(low), limit.band_difference(high - 1)
        self.zeros, self.ones, self.spare = self.most_apart + 1, 0, 0

    def allocate(self, sets: int, mean_size: float) -> None:
        """Choose how many segments get allowance 0 and 1, and how many of allowance 0 are spare, by least cost.

        Costs: one per index entry; CROWD / 2 per entry of an empty segment, up to the other sets that have the same
        segment empty; CROWD more for each empty segment beyond the spare where those are crowded.
        """
        best = None
        need = self.most_apart + 1
        for ones, share in [(0, x) for x in SPARES] + [(need // 2, 0.0)]:
            spare = math.ceil(share * need)
            zeros = need + spare - 2 * ones
            segments = zeros + ones
            fill = mean_size / segments
            empty = math.exp(-fill)
            met = min(CROWD, sets * empty)
            cost = zeros + ones * (1 + fill) + segments * empty * met / 2
            if sets * empty > CROWD:
                cost += CROWD * max(0.0, segments * empty + math.sqrt(segments * empty) - spare)
            if best is None or cost < best[0]:
                best = cost, zeros, ones, spare
        _, self.zeros, self.ones, self.spare = best

    def entries(self, shingles: np.ndarray) -> np.ndarray:
        """Index entries of one set in this band."""
        m = self.zeros + self.ones
        salt = U((self.index + 1) * int(_B) & (2**64 - 1))
        value = _mix(shingles ^ salt)
        segment = ((value >> U(20)) % U(m)).astype(np.int64)
        value = _mix(value + _A)
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment, value)
        place = np.arange(m, dtype=np.uint64) * _C + salt
        parts = [_mix(total ^ _mix(place))]
        if self.ones:
            near = segment < self.ones  # the first segments have allowance 1
            at = segment[near]
            parts.append(_mix((total[at] - value[near]) ^ _mix(place[at])))
        return np.concatenate(parts)


def bands(limit: Threshold, counts: dict[int, tuple[int, int]], largest: int) -> list[Band]:
    """The bands up to the largest set, allocated by ``counts``: band index to (sets, shingles)."""
    low = 2
    while limit.band_difference(low) < 1:  # smaller sets only link with equal ones
        low += 1
    out = []
    while low <= largest:
        high = math.ceil(low * BAND) + 1
        band = Band(len(out), low, high, limit)
        sets, shingles = counts.get(len(out), (0, 0))
        if sets:
            band.allocate(sets, shingles / sets)
        out.append(band)
        low = high
    return out


def _profile(width: int):
    def run(ids, texts, hashes):
        n, keys, sketches, wide = [], [], [], []
        for t in texts_of(texts):
            s = shingle_set(t, width)
            n.append(len(s))
            keys.append(set_key(s) if len(s) else None)
            sketches.append(sketch(s))
            wide.append(wide_sketch(s))
        marks = np.array(sketches, np.int64).reshape(len(n), SKETCH).T
        return [ids, hashes, n, keys, *map(pa.array, marks), wide]

    return run


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(ordered)))


def _pack(entries: np.ndarray, owners: np.ndarray, nodes: np.ndarray, in_bands: np.ndarray) -> bytes:
    """Sorted entries as byte planes of their steps, owners as places in a table of the members that occur."""
    members, places = np.unique(owners, return_inverse=True)
    wide = len(members) > 0xFFFF
    steps = np.diff(entries, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, : ENTRY_BITS // 8]
    head = np.array([len(entries), len(members), wide], np.int64).tobytes()
    return b"".join([head, steps.T.tobytes(), places.astype(np.uint32 if wide else np.uint16).tobytes(), nodes[members].tobytes(), in_bands[members].tobytes()])


def _unpack(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries, owners, nodes, bands)."""
    k, n, wide = np.frombuffer(blob, np.int64, 3)
    at, planes = 24, ENTRY_BITS // 8
    steps = np.zeros((k, 8), np.uint8)
    steps[:, :planes] = np.frombuffer(blob, np.uint8, k * planes, at).reshape(planes, k).T
    at += k * planes
    owners = np.frombuffer(blob, np.uint32 if wide else np.uint16, k, at).astype(np.int64)
    at += k * (4 if wide else 2)
    nodes = np.frombuffer(blob, np.uint8, 8 * n, at).view(np.int64)
    return np.cumsum(steps.reshape(-1).view(np.uint64)), owners, nodes, np.frombuffer(blob, np.uint8, 2 * n, at + 8 * n).view(np.int16)


def _index_entries(width: int, plan: list[Band], buckets: int):
    """Texts to rows (bucket, known, blob) of packed entries; a blob is ``known`` if all its entries are crowded.

    An entry that is crowded among the sets that a task holds sends no more than CROWD + 1 of them to its bucket
    as such, so that the entries of a bucket stay few where very many sets share one.
    """
    least = min((b.least for b in plan), default=1 << 60)

    def send(found, nodes, in_bands, sizes):
        entries = np.concatenate(found) >> U(64 - ENTRY_BITS)
        owners = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(entries, kind="stable")
        entries, owners = entries[order], owners[order]
        nodes, in_bands = np.array(nodes, np.int64), np.array(in_bands, np.int16)
        starts, lengths = _runs(entries)
        rank = np.arange(len(entries)) - np.repeat(starts, lengths)
        bucket = ((entries >> U(ENTRY_BITS - 24)).astype(np.int64) * buckets) >> 24
        out = [], [], []
        for known, part in ((False, rank <= CROWD), (True, rank > CROWD)):
            e, o, b = entries[part], owners[part], bucket[part]
            for start, length in zip(*_runs(b)):
                out[0].append(b[start]), out[1].append(known), out[2].append(_pack(e[start : start + length], o[start : start + length], nodes, in_bands))
        return out

    def run(batches):
        seen: set[int] = set()  # of the task at hand: equal sets in one task have their entries made once
        found, nodes, in_bands, sizes, held = [], [], [], [], 0
        for (texts,) in batches:
            for t in texts_of(texts):
                s = shingle_set(t, width)
                if len(s) < least or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                for band in plan:
                    if band.least <= len(s) < band.high:
                        e = band.entries(s)
                        found.append(e), nodes.append(key), in_bands.append(band.index), sizes.append(len(e))
                        held += len(e)
                if held > HELD_ENTRIES:
                    yield send(found, nodes, in_bands, sizes)
                    found, nodes, in_bands, sizes, held = [], [], [], [], 0
        if held:
            yield send(found, nodes, in_bands, sizes)

    return run


def _shared_entries(batches):
    """Rows (crowded, band, a, b, n) of whole buckets: pairs of nodes a < b that share n uncrowded entries of the bucket,
    or node a in the crowded entry b."""

    def crowded_rows(entries, owners, nodes, in_bands):
        return [[True] * len(entries), in_bands[owners], nodes[owners], entries.view(np.int64), np.ones(len(entries), np.int32)]

    def close(parts):
        if not parts:
            return
        offsets = np.cumsum([0] + [len(p[2]) for p in parts[:-1]])
        entries = np.concatenate([p[0] for p in parts])
        owners = np.concatenate([p[1] + o for p, o in zip(parts, offsets)])
        nodes, in_bands = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        parts.clear()
        order = np.lexsort((nodes[owners], entries))
        entries, owners = entries[order], owners[order]
        node = nodes[owners]
        fresh = np.concatenate([[True], (entries[1:] != entries[:-1]) | (node[1:] != node[:-1])])  # equal sets of several tasks
        entries, owners, node = entries[fresh], owners[fresh], node[fresh]
        starts, lengths = _runs(entries)
        crowd = np.repeat(lengths > CROWD, lengths)
        if crowd.any():
            yield crowded_rows(entries[crowd], owners[crowd], nodes, in_bands)
        left, right = [], []
        for c in range(2, CROWD + 1):  # members are in order of node, so left < right
            at = starts[lengths == c]
            if len(at):
                i, j = np.triu_indices(c, 1)
                left.append((at[:, None] + i).ravel()), right.append((at[:, None] + j).ravel())
        if left:
            left, right = np.concatenate(left), np.concatenate(right)
            a, b, band = node[left], node[right], in_bands[owners[left]]
            order = np.lexsort((b, a, band))
            a, b, band = a[order], b[order], band[order]
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (band[1:] != band[:-1])]))
            n = np.diff(np.append(starts, len(a))).astype(np.int32)
            yield [[False] * len(starts), band[starts], a[starts], b[starts], n]

    now, parts = None, []
    for bucket, known, blobs in batches:
        for b, k, blob in zip(bucket.to_pylist(), known.to_pylist(), blobs):
            if b != now:
                yield from close(parts)
                now = b
            got = _unpack(blob.as_buffer())
            if k:
                yield crowded_rows(*got)
            else:
                parts.append(got)
    yield from close(parts)


def _whole_sets(width: int, bitmap: np.ndarray):
    def run(hashes, texts):
        keep = np.flatnonzero(in_bitmap(bitmap, hashes.to_numpy(zero_copy_only=False).view(np.uint64)))
        sets = [shingle_set(t, width) for t in texts_of(texts.take(pa.array(keep)))]
        sets = [s for s in sets if len(s)]
        return [[set_key(s) for s in sets], [s.tobytes() for s in sets]]

    return run


def _sets_of(needed: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles) for at least the needed nodes, each from one of its texts."""
    reps = nodes.join(needed, "node", "left_semi").select(F.xxhash64("rep").alias("h"))
    wanted = bitmap_of(reps, "h", bitmap_size(needed.count()))
    hashed = docs.select(F.xxhash64("doc_id").alias("h"), "text")
    return arrow_map(hashed, _whole_sets(width, wanted), "node long, shingles binary", "h", "text")


def _verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets pass."""
    both = pairs.join(sets.toDF("a", "left_set"), "a").join(sets.toDF("b", "right_set"), "b")

    def run(a, b, left, right):
        keep = []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            joint = np.sort(np.concatenate([x, y]), kind="stable")
            keep.append(limit.passes(int((joint[1:] == joint[:-1]).sum()), len(x), len(y)))
        keep = pa.array(keep, pa.bool_())
        return [a.filter(keep), b.filter(keep)]

    return arrow_map(both, run, "a long, b long", "a", "b", "left_set", "right_set").distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots of all nodes after further links: components over the old roots only."""
    at = lambda c: links.join(roots.select(F.col("node").alias(c), F.col("root").alias("r")), c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
    links = at("a")
    links = at("b").filter("a <> b")
    if links.isEmpty():
        return roots
    over = components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(over, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = over.select(F.col("root").alias("node"), F.col("to").alias("root")).join(roots, "node", "left_anti")
    return materialise(old.unionByName(new))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b): least labels spread to neighbours and jump along labels."""
    both = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = materialise(step.join(jump, "root").select("node", "old", F.least("root", "far").alias("root")))
        labels = step.select("node", "root")
        if step.filter("root < old").isEmpty():
            return labels


def _may_pass(marks: list[str], num: int, den: int):
    """Whether sizes and sketches of two sets, columns ending in _l and _r, leave room for the threshold."""
    apart = sum((F.bit_count(F.col(f"{s}_l").bitwiseXOR(F.col(f"{s}_r"))) for s in marks), F.lit(0))
    total = F.col("n_l") + F.col("n_r")
    most = total - 2 * F.ceil(total * num / (num + den) - 1e-9)
    return (F.col("n_l") * den >= F.col("n_r") * num) & (F.col("n_r") * den >= F.col("n_l") * num) & (apart <= most)


def _met(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the sets shares with each of the others."""
    out = np.zeros((len(sets), len(others)), np.int64)
    both = np.intersect1d(np.concatenate(sets), np.concatenate(others))

    def places(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in both) of the common shingles, by place."""
        values, rows = np.concatenate(group), np.repeat(np.arange(len(group)), [len(x) for x in group])
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        known = both[at] == values
        order = np.argsort(at[known], kind="stable")
        return rows[known][order], at[known][order]

    if not len(both):
        return out
    sides = places(sets), places(others)
    for low in range(0, len(both), COLUMNS):
        tables = []
        for (rows, at), n in zip(sides, out.shape):
            part = slice(*np.searchsorted(at, (low, low + COLUMNS)))
            table_ = np.zeros((n, min(COLUMNS, len(both) - low)), np.float32)
            table_[rows[part], at[part] - low] = 1
            tables.append(table_)
        out += np.rint(tables[0] @ tables[1].T).astype(np.int64)
    return out


def _degrees(limit: Threshold):
    """(node, links) that the pairs of two blocks, or of one with itself, give to each of their nodes."""

    def run(x, y, nodes, blocks, copies, shingles):
        found, links = [], []
        for low, high, node, block, copy, sets in zip(x.to_pylist(), y.to_pylist(), nodes, blocks, copies, shingles):
            node, block, copy = (c.values.to_numpy() for c in (node, block, copy))
            sets = [np.frombuffer(b.as_buffer(), U) for b in sets.values]
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            size = np.array([len(b) for b in sets])
            total = size[left][:, None] + size[right]
            both = _met([sets[i] for i in left], [sets[i] for i in right])
            passes = (limit.den * both >= limit.num * (total - both)) & (node[left][:, None] != node[right])
            found.append(node[left]), links.append(passes @ copy[right])
            if low != high:
                found.append(node[right]), links.append(copy[left] @ passes)
        return [np.concatenate(found), np.concatenate(links)] if found else [[], []]

    return run


def in_blocks(rows: DataFrame, key: str, parts, columns: list[str]) -> DataFrame:
    """Groups of rows as pairs of blocks (x, y) with the columns as arrays, so that a large group spreads over many tasks.

    A row is in block ``pmod(hash of node, parts)`` of its group and goes to every pair of blocks that holds its own.
    """
    placed = rows.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("node"), "parts"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.groupBy(key, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).agg(F.collect_list(F.struct("node", "block", *columns)).alias("m"))
    return dealt.select("x", "y", *[F.col(f"m.{c}").alias(c) for c in ("node", "block", *columns)])


def _across(members: DataFrame, marks: list[str], limit: Threshold) -> DataFrame:
    """Distinct pairs (a, b) of members of one entry, of different roots, that sizes and sketches allow."""
    per = members.groupBy("entry").agg(F.ceil(F.count("*") / BLOCK_SKETCHES).alias("k"))
    dealt = in_blocks(members.join(per, "entry"), "entry", F.col("k"), ["root", "n", *marks])

    def run(x, y, nodes, blocks, roots, n, *sketches):
        left, right = [], []
        for i, (low, high) in enumerate(zip(x.to_pylist(), y.to_pylist())):
            node, block, root, size = (c[i].values.to_numpy() for c in (nodes, blocks, roots, n))
            drawn = np.stack([c[i].values.to_numpy() for c in sketches], axis=1).view(np.uint64)
            every, q = np.flatnonzero(block == low), np.flatnonzero(block == high)
            for k in range(0, len(every), COMPARED):
                p = every[k : k + COMPARED]
                total = size[p][:, None] + size[q]
                most = total - 2 * -(-limit.num * total // (limit.num + limit.den))
                apart = sum(np.bitwise_count(drawn[p][:, None, s] ^ drawn[q][None, :, s]).astype(np.int32) for s in range(SKETCH))
                a, b = np.nonzero((root[p][:, None] != root[q]) & (apart <= most))
                left.append(np.minimum(node[p][a], node[q][b])), right.append(np.maximum(node[p][a], node[q][b]))
        return [np.concatenate(left), np.concatenate(right)] if left else [[], []]

    return arrow_map(dealt, run, "a long, b long", *dealt.columns).distinct()


def true_degrees(members: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """(node, links): the rows with other sets that each node links with, for (node, root, n, copies) of whole components.

    A component is cut into blocks, and each two blocks are compared by one row, so a large one spreads over many tasks.
    """
    per = members.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("size")).filter("k > 1")
    per = per.select("root", F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("size") / BLOCK_SHINGLES)).alias("per_root"))
    dealt = in_blocks(members.join(per, "root").join(sets, "node"), "root", F.col("per_root"), ["copies", "shingles"])
    return arrow_map(dealt, _degrees(limit), "node long, links long", *dealt.columns).groupBy("node").agg(F.sum("links").alias("links"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def grouped(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The profile of every document, the nodes (distinct sets), and the roots (node, root) of those with links."""
    limit = Threshold(num, den)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    marks = [f"s{i}" for i in range(SKETCH)]
    profile = materialise(arrow_map(hashed, _profile(width), "doc_id long, text_hash long, n_shingles long, node long, " + ", ".join(f"{s} long" for s in marks) + ", wide binary", "doc_id", "text", "text_hash"))
    nodes = materialise(profile.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"), *[F.first(s).alias(s) for s in [*marks, "wide"]]))
    largest = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    bounds = bands(limit, {}, largest)
    in_band = [F.struct(F.count_if((F.col("n") >= b.least) & (F.col("n") < b.high)), F.coalesce(F.sum(F.when((F.col("n") >= b.least) & (F.col("n") < b.high), F.col("n"))), F.lit(0))) for b in bounds]
    counted = nodes.agg(*in_band).first() if bounds else ()
    counted = {i: tuple(c) for i, c in enumerate(counted)}
    plan = bands(limit, counted, largest)
    if not plan:
        return profile, nodes, nodes.select("node", F.col("node").alias("root")).limit(0)

    def possible(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) that their sizes and sketches allow."""
        facts = ["n", *marks]
        both = pairs.distinct().join(nodes.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_l") for c in facts]), "a")
        both = both.join(nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_r") for c in facts]), "b")
        return widely_possible(both.filter(_may_pass(marks, num, den)).select("a", "b"))

    def widely_possible(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that the wide sketches of large sets allow."""
        wide = nodes.select("node", "n", "wide")
        both = pairs.join(wide.toDF("a", "n_a", "wide_a"), "a").join(wide.toDF("b", "n_b", "wide_b"), "b")

        def run(a, b, n_a, n_b, x, y):
            keep = [w is None or v is None or wide_distance(w, v) <= limit.difference(n + m) for n, m, w, v in zip(*(c.to_pylist() for c in (n_a, n_b, x, y)))]
            keep = pa.array(keep, pa.bool_())
            return [a.filter(keep), b.filter(keep)]

        return arrow_map(both, run, "a long, b long", "a", "b", "n_a", "n_b", "wide_a", "wide_b")

    # The index: packed entries, whole buckets at a time.
    total = sum(counted.get(band.index, (0, 0))[0] * (band.zeros + band.ones) + (counted.get(band.index, (0, 0))[1] if band.ones else 0) for band in plan)
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, total // BUCKET_ENTRIES + 1)
    packed = arrow_stream(docs, _index_entries(width, plan, buckets), "bucket int, known boolean, blob binary", "text")
    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    shared = materialise(arrow_stream(dealt, _shared_entries, "crowded boolean, band smallint, a long, b long, n int", "bucket", "known", "blob"))

    spare = F.element_at(F.array(*[F.lit(band.spare) for band in plan]), F.col("band") + 1)
    crowds = shared.filter("crowded").select("band", F.col("a").alias("node"), F.col("b").alias("entry")).distinct()
    per_node = materialise(crowds.groupBy("band", "node").agg(F.count("*").alias("crowds")))
    met = shared.filter("not crowded").groupBy("band", "a", "b").agg(F.sum("n").alias("n"))
    met = met.join(per_node.select("band", F.col("node").alias("a"), F.col("crowds").alias("x")), ["band", "a"], "left")
    met = met.join(per_node.select("band", F.col("node").alias("b"), F.col("crowds").alias("y")), ["band", "b"], "left")
    met = met.filter(F.col("n") > spare - F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).select("a", "b")
    beyond = per_node.filter(F.col("crowds") > spare).withColumn("kept", F.col("crowds") - spare)
    place = F.row_number().over(Window.partitionBy("band", "node").orderBy("entry"))
    kept = crowds.join(beyond, ["band", "node"]).withColumn("place", place).filter("place <= kept").select("entry", "node")
    members = materialise(kept.join(kept.groupBy("entry").agg(F.min("node").alias("hub"), F.count("*").alias("c")).filter("c > 1"), "entry").select("entry", "node", "hub"))
    tied = members.filter("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = materialise(possible(met.union(tied)))
    discard(shared, per_node)
    links = materialise(_verified(stars, _sets_of(ends_of(stars), nodes, docs, width), limit))
    roots = components(links)

    # Kept entries that still hold several components: while their pairs are many, one member of each entry, the same
    # one for entries that share it, is tried with all others, which merges most; then blocks of members are compared.
    tried = stars
    for turn in range(HUB_TURNS + 1):
        placed = members.select("entry", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        by_root = placed.groupBy("entry", "root").agg(F.count("*").alias("c"))
        mixed = by_root.groupBy("entry").agg((F.pow(F.sum("c"), 2) - F.sum(F.pow("c", F.lit(2)))).alias("cross")).filter("cross > 0")
        open_ = materialise(placed.join(mixed, "entry"))
        rows, cross = open_.select(F.count("*"), F.coalesce(F.sum(F.col("cross") / 2), F.lit(0.0))).first()
        if not rows:
            break
        if turn < HUB_TURNS and cross > 4 * rows:
            hub = open_.groupBy("entry").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("hub"), F.col("root").alias("hub_root"))).alias("h")).select("entry", "h.hub", "h.hub_root")
            pairs = possible(open_.join(hub, "entry").filter("root <> hub_root").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")))
        else:
            turn = HUB_TURNS
            pairs = widely_possible(_across(open_.select("entry", "node", "root").join(nodes.drop("rep", "wide", "copies"), "node"), marks, limit))
        rest = materialise(pairs.join(tried, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            found = materialise(_verified(rest, _sets_of(ends_of(rest), nodes, docs, width), limit))
            roots = _merged(roots, found)
        if turn == HUB_TURNS:
            break
        tried = tried.union(rest)

    return profile, nodes, roots


def similar_sets(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    ``component_id`` is the least ``doc_id`` of the component; ``n_links`` counts the other rows whose sets pass the
    threshold with the document's, equal ones included.
    """
    docs = docs.select("doc_id", "text")
    profile, nodes, roots = grouped(docs, width, num, den)
    members = materialise(nodes.select("node", "n", "copies").join(roots, "node"))
    sets = _sets_of(members.select("node"), nodes, docs, width).dropDuplicates(["node"])
    degree = true_degrees(members, sets, Threshold(num, den))
    known = nodes.select("node", "rep", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_node = known.join(least, "root").join(degree, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = profile.select("doc_id", "n_shingles", "node").join(by_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """One document of each component, that of the least ``doc_id`` (null last), with its columns; documents without
    words all stay.

    Rows are told apart by ``doc_id`` and a hash of the text; of rows alike in both, any one stays.
    """
    profile, _, roots = grouped(docs.select("doc_id", "text"), width, num, den)
    rows = profile.filter("node is not null").select("doc_id", "text_hash", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    alike = rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "rows")).alias("k")
    kept = materialise(alike.groupBy("root").agg(first).select("k.doc_id", "k.text_hash", "k.rows"))
    wordless = profile.filter("node is null").select("doc_id", "text_hash").distinct()
    # Each document is one struct, so that no column names clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))

    def of(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
        return packed.join(keys, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")

    single = of(kept.filter("rows = 1").select("doc_id", "text_hash").union(wordless))
    repeated = of(kept.filter("rows > 1")).dropDuplicates(["id", "hash"])
    return single.unionByName(repeated).select("row.*")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))
