"""Toxicity by compression distance.

zstandard's trainer makes dictionaries from windows of running words: a base and an ordinary one from ordinary texts,
a toxic one from toxic texts. Both sides compress with the base, so that they differ by their own part alone. Which
windows of a toxic text are the toxic ones is not labelled, so the toxic dictionary is trained in rounds: on all
windows of toxic texts first, then on those that it shortens, against the ordinary side, by more than nearly all ordinary
windows. No words are chosen or listed; dictionary content is what the trainer takes from windows.

A text is scored by its distinct windows of one word each, lower-cased and stripped of punctuation, between a constant
header and trailer that both sides hold (zstandard stores shorter input as it is). Each has a difference of the two
lengths and a residue, its toxic length above that of no word at all; parts of words match as well as whole ones.
Counts of windows beyond several thresholds, under dictionaries of two shapes, are calibrated into a probability by
boosted trees on labelled texts that the dictionaries have not seen.

The labelled rows used are at most ``toxic`` and ``ordinary`` texts, those with the least hash of ``doc_id`` whose
crc32 modulo 5 is not 0. Other columns are never inputs of a score.

Defined cases: null and empty texts get the score of a text without windows; without labelled rows of both kinds, or
with too little text to train a dictionary on, every score is 0; repeated rows give repeated results; an empty table
gives an empty result; further columns are kept by ``drop_toxic`` and ignored elsewhere, whatever their names.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, arrow_map, arrow_stream, crc_mod, table, texts_of, worker_model
from ._gbdt import BoostedTrees

TOXIC_SAMPLE, ORDINARY_SAMPLE = 2500, 6000
#: Characters of labelled text that are learned from at most.
SAMPLE_BYTES = 64_000_000
#: Words of a training window of the base and the ordinary dictionary, and of a window that rounds choose from.
LONG_WINDOW, SHORT_WINDOW = 16, 2
#: Shapes of the two pairs of dictionaries: bytes of the base and of a part, the trainer's segment and unit for parts.
SHAPES = ((65536, 4096, 16, 6), (32768, 8192, 16, 8))
BASE_SEGMENT, BASE_UNIT = 64, 8
#: Rounds of the toxic dictionary, and the share of ordinary windows that a chosen window must exceed.
ROUNDS, BEYOND = 3, 0.99
EDGES = ".,;:!?#*$%&|<>\"'()[]"
HEAD, TAIL = bytes(range(128, 152)), bytes(range(192, 204))
#: (difference, residue): a window counts when at least the one and at most the other; beyond the largest residue, where
#: the toxic side found little, the difference is taken as 0.
THRESHOLDS = tuple((d, r) for d in (1, 2, 3, 4, 5) for r in (1, 2, 3, 4))
MOST_RESIDUE = max(r for _, r in THRESHOLDS)
#: Windows kept in a worker; beyond that a new store starts and the one before serves it. Workers outlive a task, so one
#: model is kept.
KEPT_WINDOWS = 100_000

_words = re.compile(WORD).findall


def windows(text: str) -> list[str]:
    """The distinct windows of a text, sorted."""
    return sorted({w for x in set(_words(text.lower())) if (w := x.strip(EDGES))})


def running(texts: list[str], width: int) -> list[bytes]:
    """Windows of ``width`` words that follow one another, of all texts."""
    out = []
    for t in texts:
        words = _words(t.lower())
        out += [f" {' '.join(words[i : i + width])} ".encode() for i in range(0, len(words), width)]
    return out


def _compressor(dictionary: bytes):
    settings = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        window_log=18, hash_log=16, chain_log=17, search_log=4, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
    )
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=settings).compress


def _trained(samples: list[bytes], size: int, segment: int, unit: int) -> bytes:
    return zstandard.train_dictionary(size, samples, k=segment, d=unit).as_bytes()


def _lengths(compress, samples: list[bytes]) -> np.ndarray:
    return np.array([len(compress(HEAD + x + TAIL)) for x in samples], np.int64)


def train_dictionaries(toxic: list[str], ordinary: list[str], base_bytes: int, part_bytes: int, segment: int, unit: int) -> tuple[bytes, bytes]:
    """The toxic and the ordinary side, base included."""
    base = _trained(running(ordinary[::2], LONG_WINDOW), base_bytes, BASE_SEGMENT, BASE_UNIT)
    plain = base + _trained(running(ordinary[1::2], LONG_WINDOW), part_bytes, segment, unit) + TAIL + HEAD
    pool, others = running(toxic, SHORT_WINDOW), running(ordinary[1::8], SHORT_WINDOW)
    pool_plain, others_plain = (_lengths(_compressor(plain), x) for x in (pool, others))
    chosen = pool
    for turn in range(ROUNDS + 1):
        marked = base + _trained(chosen, part_bytes, segment, unit) + TAIL + HEAD
        if turn < ROUNDS:
            shorter, by_chance = (x - _lengths(_compressor(marked), y) for x, y in ((pool_plain, pool), (others_plain, others)))
            picked = np.flatnonzero(shorter > np.quantile(by_chance, BEYOND))
            if sum(len(pool[i]) for i in picked) > 2 * part_bytes:  # else too few to train on
                chosen = [pool[i] for i in picked]
    return marked, plain


class Distances:
    """Window lengths under pairs of dictionaries. A window is kept as the number of its row of differences and residues."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.sides = [(_compressor(toxic), _compressor(ordinary)) for toxic, ordinary in pairs]
        self.floors = [len(toxic(HEAD + b" " + TAIL)) for toxic, _ in self.sides]
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.numbers: dict[tuple[int, ...], int] = {}
        self.rows = np.zeros((0, 2 * len(pairs)), np.int32)
        self.marks = np.zeros((0, len(pairs) * len(THRESHOLDS)), np.int32)

    def _of(self, word: str) -> tuple[int, ...]:
        x, out = HEAD + f" {word} ".encode() + TAIL, []
        for (toxic, ordinary), floor in zip(self.sides, self.floors):
            n = len(toxic(x))
            out += [len(ordinary(x)) - n, n - floor] if n - floor <= MOST_RESIDUE else [0, n - floor]
        return tuple(out)

    def _numbers_of(self, words: list[str]) -> list[int]:
        if len(self.kept) > KEPT_WINDOWS:
            self.kept, self.older = {}, self.kept
        kept, older, numbers = self.kept, self.older, self.numbers
        for w in words:
            if w not in kept:
                at = older.get(w)
                if at is None:
                    row = self._of(w)
                    at = numbers.setdefault(row, len(numbers))
                kept[w] = at
        if len(numbers) > len(self.rows):
            self.rows = np.array(list(numbers), np.int32)
            self.marks = np.hstack([(self.rows[:, k, None] >= [d for d, _ in THRESHOLDS]) & (self.rows[:, k + 1, None] <= [r for _, r in THRESHOLDS]) for k in range(0, self.rows.shape[1], 2)]).astype(np.int32)
        return [kept[w] for w in words]

    def of(self, words: list[str]) -> np.ndarray:
        """Rows of difference and residue, by pair."""
        at = self._numbers_of(words)
        return self.rows[at]

    def features(self, words: list[str]) -> np.ndarray:
        at = self._numbers_of(words)
        if not at:
            return np.zeros(1 + len(self.sides) * (1 + 2 * len(THRESHOLDS)))
        counts = self.marks[at].sum(axis=0)
        return np.concatenate([[len(at)], counts, counts / len(at), self.rows[at, ::2].max(axis=0)])


class ToxicityModel:
    def __init__(self, pairs: list[tuple[bytes, bytes]], trees: BoostedTrees | None):
        self.pairs, self.trees = pairs, trees

    def score(self, texts: list[str]) -> list[float]:
        if self.trees is None or not texts:
            return [0.0] * len(texts)
        distances = worker_model((__name__, *self.pairs), lambda: Distances(self.pairs))
        return self.trees.score(np.array([distances.features(windows(t)) for t in texts])).tolist()


def fit(rows: list[tuple[str, int]]) -> ToxicityModel:
    """From (text, label) rows: dictionaries from two thirds, calibration on the rest."""
    nothing = ToxicityModel([], None)
    learn, held = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    toxic, ordinary = ([t for t, y in learn if y == label] for label in (1, 0))
    y = np.array([label for _, label in held])
    if not toxic or not ordinary or len(set(y.tolist())) < 2:
        return nothing
    try:
        pairs = [train_dictionaries(toxic, ordinary, *shape) for shape in SHAPES]
    except zstandard.ZstdError:  # the trainer refuses too few or too short samples
        return nothing
    distances = Distances(pairs)
    x = np.array([distances.features(windows(t)) for t, _ in held])
    return ToxicityModel(pairs, BoostedTrees(trees=60, depth=3).fit(x, y))


def _fitted(batches):
    """The model of all rows, as one row. Rows beyond ``SAMPLE_BYTES`` of text are not used."""
    rows, size = [], 0
    for texts, labels in batches:
        for text, label in zip(texts_of(texts), labels.to_pylist()):
            size += len(text)
            if size <= SAMPLE_BYTES:
                rows.append((text, label))
    yield [[pickle.dumps(fit(rows))]]


def learn_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, ordinary: int = ORDINARY_SAMPLE) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows; the ids that reach the join are at most ``toxic + ordinary``.

    One task of an executor gets the sample, of at most ``SAMPLE_BYTES`` characters, and fits the model; the driver gets
    the model alone, whose size its parameters fix.
    """
    usable = labels.select("doc_id", "toxic").filter(crc_mod(F.col("doc_id"), 5) != 0)
    drawn = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, toxic), (0, ordinary))]
    picked = F.broadcast(drawn[0].union(drawn[1]))
    joined = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", "toxic")
    rows = joined.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(toxic + ordinary)
    told = arrow_stream(rows.coalesce(1), _fitted, "model binary", "text", "toxic").collect()
    return pickle.loads(told[0]["model"]) if told else ToxicityModel([], None)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) of every document."""

    def run(ids, texts):
        score = model.score(texts_of(texts))
        return [ids, score, [int(s >= 0.5) for s in score]]

    return arrow_map(docs, run, "doc_id long, score double, predicted int", "doc_id", "text")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that the model does not reject, with their columns."""
    names = docs.columns
    at = names.index("text")

    def run(*columns):
        keep = pa.array([s < 0.5 for s in model.score(texts_of(columns[at]))], pa.bool_())
        return [c.filter(keep) for c in columns]

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *names)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
