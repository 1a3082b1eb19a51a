"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is split by the vocabulary's pattern; a piece that is itself a token is taken whole, any other is merged
pair by pair, the leftmost pair of least rank first. A segment tree over the byte positions holds that pair at its
root, so each merge costs a logarithmic number of point updates on the live neighbours, however long the piece is.

Defined cases: null and empty texts give no ids and empty bytes; lone surrogates cannot occur in Spark strings;
repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame

from ._common import arrow_stream, table, texts_of, worker_model

#: Pieces kept per worker with their ids; longer pieces are never kept.
CACHED_PIECES, CACHED_BYTES = 400_000, 64
#: What a worker takes up at once: bytes of pieces that merge together, characters of texts.
MERGED_BYTES, RUN_CHARS = 1 << 18, 500_000


def segment_tree_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece. Every single byte must be in ``ranks``."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    none = 1 << 62
    shift = n.bit_length()
    # A leaf holds rank and position of the pair that starts there as one number, so a minimum is the leftmost least.
    tree = [none] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r << shift | i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 2))  # start of the next live part
    before = list(range(-1, n))
    mask = (1 << shift) - 1

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    def pair(i: int) -> int:
        mid = after[i]
        if mid >= n:
            return none
        r = get(piece[i : after[mid]])
        return none if r is None else r << shift | i

    while tree[1] != none:
        i = tree[1] & mask
        gone = after[i]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        if gone < n - 1:
            put(gone, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class BytePairCodec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)])
        keys, made = array("q", [-1]), array("q", [0])
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b), made.append(r)
        order = np.argsort(np.asarray(keys))
        self.pair_keys, self.pair_ranks = np.asarray(keys)[order], np.asarray(made)[order]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make, -1 where there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """``segment_tree_merge`` of many short pieces at once: one row of each array is one piece's tree."""
        n = np.array([len(p) for p in pieces])
        width = 1 << max(1, int(n.max() - 1).bit_length())
        shift, none = width.bit_length(), 1 << 62
        raw = np.zeros((len(pieces), width + 1), dtype=np.uint8)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        rows = np.repeat(np.arange(len(pieces)), n)
        raw[rows, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        ids = self.byte_ids[raw]
        places = np.arange(width)
        alive = places < n[:, None]
        tree = np.full((len(pieces), 2 * width), none, dtype=np.int64)
        r, c = np.nonzero(places < n[:, None] - 1)
        rank = self._pair(ids[r, c], ids[r, c + 1])
        tree[r, width + c] = np.where(rank < 0, none, rank << shift | c)
        for level in range(width // 2, 0, -1) if width < 4 else [width >> k for k in range(1, width.bit_length())]:
            span = np.arange(level, 2 * level)
            tree[:, span] = np.minimum(tree[:, 2 * span], tree[:, 2 * span + 1])
        after = np.tile(np.arange(1, width + 2), (len(pieces), 1))
        before = np.tile(np.arange(-1, width + 1), (len(pieces), 1))
        r = np.flatnonzero(tree[:, 1] != none)
        while len(r):
            root = tree[r, 1]
            i = root & ((1 << shift) - 1)
            gone = after[r, i]
            following = after[r, gone]
            ids[r, i], alive[r, gone] = root >> shift, False
            after[r, i], before[r, following] = following, i
            previous = before[r, i]
            right = np.where(following < n[r], self._pair(ids[r, i], ids[r, np.minimum(following, width)]), -1)
            left = np.where(previous >= 0, self._pair(ids[r, np.maximum(previous, 0)], ids[r, i]), -1)
            nodes = [width + gone, width + i, np.where(previous >= 0, width + previous, width + i)]
            tree[r, nodes[0]] = none
            tree[r, nodes[1]] = np.where(right < 0, none, right << shift | i)
            has = previous >= 0
            tree[r[has], nodes[2][has]] = np.where(left < 0, none, left << shift | previous)[has]
            while nodes[0][0] > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[r, x] = np.minimum(tree[r, 2 * x], tree[r, 2 * x + 1])
            r = r[tree[r, 1] != none]
        out, ends = ids[:, :width][alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [tuple(out[a:b]) for a, b in zip([0, *ends], ends)]

    def _learn(self, missing: set[str]) -> None:
        """Put the ids of pieces into ``kept``, those of like length together."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in missing:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.kept[piece] = (whole,)
            elif len(raw) <= CACHED_BYTES:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in by_width.values():
            step = max(1, MERGED_BYTES // max(len(raw) for _, raw in group))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                self.kept.update(zip([p for p, _ in part], self.merge_many([raw for _, raw in part])))

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        split = [self.find(t) for t in texts]
        if len(self.kept) >= CACHED_PIECES:
            self.kept.clear()
        kept = self.kept
        self._learn({p for pieces in split for p in pieces if p not in kept})
        out = []
        for pieces in split:
            ids: list[int] = []
            for p in pieces:
                got = kept.get(p)
                ids.extend(got if got is not None else segment_tree_merge(p.encode(), self.ranks))
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def in_runs(texts: list[str], chars: int = RUN_CHARS):
    """Runs of texts of about so many characters, so that their pieces fit in memory."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def codec(path: str, pattern: str) -> BytePairCodec:
    """The worker process's codec of a vocabulary."""

    def make() -> BytePairCodec:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return BytePairCodec(ranks, pattern)

    return worker_model((__name__, path, pattern), make)


def ids_digest(ids) -> str:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return hashlib.sha256(packed.tobytes()).hexdigest()


def _encoded(docs: DataFrame, path: str, pattern: str, schema: str, *of) -> DataFrame:
    """doc_id and what each function of ``of`` makes of the codec and the ids of a text. Each run of texts is its own Arrow
    batch, so neither a worker nor the executor holds the ids of more."""

    def body(batches):
        for ids, texts in batches:
            c, at = codec(path, pattern), 0
            for run in in_runs(texts_of(texts)):
                encoded = c.encode_many(run)
                yield [ids.slice(at, len(run)), *[[f(c, e) for e in encoded] for f in of]]
                at += len(run)

    return arrow_stream(docs, body, f"doc_id long, {schema}", "doc_id", "text")


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of each text."""
    return _encoded(docs, path, pattern, "ids array<int>", lambda c, e: e)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each text and the bytes they decode to."""
    return _encoded(docs, path, pattern, "ids array<int>, decoded binary", lambda c, e: e, lambda c, e: c.decode(e))


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), made where the ids are, so that they need not leave the worker."""
    digests = lambda c, e: len(e), lambda c, e: ids_digest(e), lambda c, e: hashlib.sha256(c.decode(e)).hexdigest()
    return _encoded(docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", *digests)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), *public_vocabulary())
