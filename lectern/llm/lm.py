"""Language-model scoring: an add-one unigram base and a log-bilinear neural model, both learned from the corpus.

Documents are dealt into blocks by a hash of id and text; a block holds about ``BLOCK_CHARS`` characters. Each block
counts its training words, the counts are summed per word over all blocks, and each block gets the totals of its own
words back, so no table of all words is ever in one place. Words are told apart by 64-bit hashes.

The neural model knows the ``words`` most frequent training words, the end and one class for all others. It is
trained in numpy by noise-contrastive estimation on every training document, in ``ROUNDS`` rounds: every block starts from
the same parameters, makes ``EPOCHS`` passes over its distinct trigrams with their counts, and the blocks' parameters are
averaged by weight. Blocks do not depend on how the input is split into files, so neither do the scores, but for the order
of floating-point sums. Scores are normalised: batched matrix products give all logits of each distinct context, once a
worker, and a word outside the vocabulary gets the class's probability times its add-one share among such words, so the counts, which
grow with the input, reach every word.

Defined cases: a null or empty text is the end token alone; without training documents all counts are 0 and the base
is that of an unknown word; repeated rows are scored and counted each, and share a block; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_stream, bounded_batches, crc_mod, discard, materialise, release_shuffles, table, worker_model
from .ngram_join import words_of_texts

BLOCK_CHARS = 8_000_000
#: Words of the neural model, a parameter: CPU time grows with it, scores of all other words rest on their counts.
WORDS, SIZE, NOISE, ROUNDS, EPOCHS, RATE = 1024, 24, 64, 2, 1, 0.08
#: Contexts whose normalisers a worker keeps: more than there are with 4,000 words.
KEPT_CONTEXTS = 1 << 24
END = np.uint64(0x0E4D0F7E87)  # stands for the end among the hashes


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, then the end."""
    return tokens_of([text])[0]


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, each text with the end after it, and tokens of each text."""
    words, n = words_of_texts([t or "" for t in texts])
    return np.insert(words, np.cumsum(n), END), n + 1


class LogBilinear:
    """p(w | u, v) proportional to exp(q(u, v) . R[w] + b[w]), with q the sum of position vectors of the two words before."""

    def __init__(self, log_share: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = len(log_share)
        self.log_noise = log_share.astype(np.float32)
        self.far = rng.normal(0, 0.1, (n + 1, SIZE)).astype(np.float32)  # the last row stands before the text
        self.near = rng.normal(0, 0.1, (n + 1, SIZE)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (n, SIZE)).astype(np.float32)
        self.bias = log_share.astype(np.float32).copy()
        self.norms: np.ndarray | None = None

    def parameters(self) -> np.ndarray:
        n = len(self.bias)
        pad = np.zeros((1, SIZE + 1), np.float32)
        return np.hstack([self.far, self.near, np.vstack([np.hstack([self.out, self.bias[:, None]]), pad])]).astype(np.float32).reshape(n + 1, -1)

    def load(self, rows: np.ndarray) -> LogBilinear:
        self.far, self.near = rows[:, :SIZE].astype(np.float32), rows[:, SIZE : 2 * SIZE].astype(np.float32)
        self.out, self.bias = rows[:-1, 2 * SIZE : 3 * SIZE].astype(np.float32), rows[:-1, 3 * SIZE].astype(np.float32)
        return self

    def train(self, trigrams: np.ndarray, counts: np.ndarray, epochs: int = EPOCHS, batch: int = 2048, seed: int = 11) -> LogBilinear:
        """Noise-contrastive estimation with noise words shared by a batch; Adagrad steps."""
        rng = np.random.default_rng(seed)
        noise = np.exp(self.log_noise.astype(float))
        noise /= noise.sum()
        cumulative = np.cumsum(noise)
        log_k = np.float32(np.log(NOISE))
        sums = [np.full(x.shape, 1e-3, np.float32) for x in (self.far, self.near, self.out, self.bias)]
        for _ in range(epochs):
            order = rng.permutation(len(trigrams))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                u, v, w = trigrams[pick].T
                weight = counts[pick].astype(np.float32)
                weight /= weight.mean()
                q = self.far[u] + self.near[v]
                drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), len(noise) - 1)
                true = np.einsum("ij,ij->i", q, self.out[w]) + self.bias[w] - self.log_noise[w] - log_k
                false = q @ self.out[drawn].T + self.bias[drawn] - self.log_noise[drawn] - log_k
                g_true = weight * _sigmoid(-true)  # gradients of the log-likelihood
                g_false = -weight[:, None] * _sigmoid(false)
                g_q = g_true[:, None] * self.out[w] + g_false @ self.out[drawn]
                for table_, total, at, g in (
                    (self.far, sums[0], u, g_q), (self.near, sums[1], v, g_q),
                    (self.out, sums[2], np.concatenate([w, drawn]), np.vstack([g_true[:, None] * q, g_false.T @ q])),
                    (self.bias, sums[3], np.concatenate([w, drawn]), np.concatenate([g_true, g_false.sum(0)])),
                ):
                    _step(table_, total, at, g / len(pick) ** 0.5)
        return self

    def log_probabilities(self, contexts: np.ndarray, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logs of p(words[i] | contexts[rows[i]]); a context is its two classes before."""
        return self.log_scores((contexts[:, 0] * (len(self.bias) + 1) + contexts[:, 1])[rows], words)

    def log_scores(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logs of p(words[i] | contexts[i]). Contexts are numbers (before last) * (words + 1) + (last).

        The normaliser of a context is made in batches of a matrix product with all words, and kept where there are at most
        ``KEPT_CONTEXTS`` contexts.
        """
        n = len(self.bias) + 1
        if self.norms is None:
            self.norms = np.full(n * n if n * n <= KEPT_CONTEXTS else 0, np.nan)
        distinct = np.unique(contexts)
        norms = self.norms[distinct] if len(self.norms) else np.full(len(distinct), np.nan)
        new = np.flatnonzero(np.isnan(norms))
        for k in range(0, len(new), 2048):
            c = distinct[new[k : k + 2048]]
            logits = (self.far[c // n] + self.near[c % n]) @ self.out.T + self.bias
            top = logits.max(axis=1)
            norms[new[k : k + 2048]] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
        if len(self.norms):
            self.norms[distinct[new]] = norms[new]
        pairs, at = np.unique(contexts * n + words, return_inverse=True)
        c, w = pairs // n, pairs % n
        logit = np.empty(len(pairs))
        for k in range(0, len(pairs), 1 << 16):
            part = slice(k, k + (1 << 16))
            logit[part] = np.einsum("ij,ij->i", self.far[c[part] // n] + self.near[c[part] % n], self.out[w[part]]) + self.bias[w[part]]
        return (logit - norms[np.searchsorted(distinct, c)])[at]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _step(values: np.ndarray, total: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
    """One Adagrad step on the rows ``at``, which may repeat."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    rows, g = at[order][first], np.add.reduceat(g[order], first, axis=0)
    total[rows] += g * g
    values[rows] += RATE * g / np.sqrt(total[rows])


class Vocabulary:
    """Hashes of the words that the neural model knows; the class after the last is that of all others."""

    def __init__(self, words: np.ndarray):
        order = np.argsort(words)
        self.sorted, self.place, self.other = words[order], order, len(words)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.other - 1)
        return np.where(self.sorted[at] == hashes, self.place[at], self.other)


def contexts_of(classes: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The two classes before each token of texts laid end to end; ``start`` stands before a text."""
    first = np.cumsum(lengths) - lengths
    near = np.concatenate([[start], classes[:-1]])
    far = np.concatenate([[start] * 2, classes[:-2]])[: len(classes)]
    near[first] = far[first] = start
    far[first[lengths > 1] + 1] = start
    return far * (start + 1) + near


def _blocks(batches, *merged: int):
    """(block, columns) of each run of one block; ``merged`` columns come as lists over the whole run, batch by batch."""
    now, held = None, None
    for columns in batches:
        blocks = columns[0].to_numpy()
        cut = np.flatnonzero(np.diff(blocks)) + 1
        for a, b in zip([0, *cut], [*cut, len(blocks)]):
            if a == b:
                continue
            part = [columns[k].slice(a, b - a) for k in merged]
            if blocks[a] != now and now is not None:
                yield now, held
                held = None
            now = blocks[a]
            held = [[*h, p] for h, p in zip(held, part)] if held else [[p] for p in part]
    if now is not None:
        yield now, held


def _distinct_trigrams(texts: list, vocabulary: Vocabulary, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (two before, one before, word) triples of a block's texts, with their counts."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in texts:
        flat, lengths = tokens_of(part.to_pylist())
        w = vocabulary.of(flat)
        key = contexts_of(w, lengths, start) * start + w
        new, n = np.unique(key, return_counts=True)
        keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(keys))
    context = keys // start
    return np.stack([context // (start + 1), context % (start + 1), keys % start], axis=1), counts


def _train(dealt: DataFrame, model: LogBilinear, vocabulary: Vocabulary, turn: int) -> LogBilinear:
    """One round: local training on every block and averaging of the parameters."""
    begin, noise, start = model.parameters(), model.log_noise, len(model.bias)

    def body(batches):
        total, weights = np.zeros(begin.shape), 0.0
        for _, (texts,) in _blocks(batches, 1):
            trigrams, weight = _distinct_trigrams(texts, vocabulary, start)
            w = float(weight.sum())
            total += LogBilinear(noise).load(begin).train(trigrams, weight, seed=11 + turn).parameters().astype(float) * w
            weights += w
        if weights:
            yield [list(range(len(total))), total.tolist(), [weights] * len(total)]

    width = begin.shape[1]
    told = arrow_stream(dealt, body, "row int, p array<double>, w double", "block", "text")
    sums = told.groupBy("row").agg(F.sum("w").alias("w"), *[F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(width)])
    rows = sums.orderBy("row").collect()  # as many as the model has words
    return model.load(np.array([[r[2 + i] / r["w"] for i in range(width)] for r in rows])) if rows else model


def _count_blocks(batches):
    """(block, word, training count) of the distinct words of each block."""
    for block, (held, texts) in _blocks(batches, 1, 2):
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for h, t in zip(held, texts):
            flat, lengths = tokens_of(t.to_pylist())
            counted = np.repeat(~np.array(h.to_pylist(), bool), lengths)
            new, at = np.unique(flat, return_inverse=True)
            n = np.bincount(at, counted, len(new)).astype(np.int64)
            words, at = np.unique(np.concatenate([words, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(words)).astype(np.int64)
        yield [np.full(len(words), block, np.int32), words.view(np.int64), counts]


def score_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    bounded_batches(docs.sparkSession)
    chars = docs.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(1))).first()[0]
    n_blocks = int(chars // BLOCK_CHARS + 1)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    held = crc_mod(F.col("doc_id"), 7) == 2
    dealt = docs.select(block.alias("block"), "doc_id", held.alias("held"), "text")
    dealt = materialise(dealt.repartition(n_blocks, "block").sortWithinPartitions("block", "held", "doc_id"))

    # One row for each word of a block; a common word has as many as there are blocks, so its total comes by a partial
    # aggregate and goes back by a join, which may split it, and never by a window.
    local = materialise(arrow_stream(dealt, _count_blocks, "block int, word long, n long", "block", "held", "text"))
    release_shuffles(docs.sparkSession)
    totals = materialise(local.groupBy("word").agg(F.sum("n").alias("n")))
    end = int(END)
    n, v, ends = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum(F.when(F.col("word") == end, F.col("n"))), F.lit(0))).first()
    top = totals.filter((F.col("n") > 0) & (F.col("word") != end)).orderBy(F.desc("n"), "word").limit(words).collect()
    vocabulary = Vocabulary(np.array([end, *[r["word"] for r in top]], np.int64).view(np.uint64))
    frequent = np.array([ends, *[r["n"] for r in top]], float)
    # The class of other words: all their tokens, and one place for each of them and for the unknown.
    other_n, other_v = n - frequent.sum(), max(0, v - len(frequent) + (ends == 0))
    share = np.append(frequent + 1, other_n + other_v + 1)
    model = LogBilinear(np.log(share / share.sum()))
    for turn in range(ROUNDS):
        model = _train(dealt.filter("not held"), model, vocabulary, turn)
    final, noise, start = model.parameters(), model.log_noise, len(share)
    release_shuffles(docs.sparkSession)
    mine = (__name__, sha256(final.tobytes()).hexdigest())  # tasks of one worker share the model and its normalisers
    floor, other_floor, log10 = np.log10(n + v + 1), np.log10(other_n + other_v + 1), np.log(10.0)

    def score(batches):
        m, known, counts, now = worker_model(mine, lambda: LogBilinear(noise).load(final)), [], [], None
        table_ = None
        for batch in batches:
            blocks, kinds = batch[0].to_numpy(), batch[1].to_numpy()
            cut = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(blocks)] if len(blocks) else []):
                part = [c.slice(a, b - a) for c in batch]
                if blocks[a] != now:
                    now, known, counts, table_ = blocks[a], [], [], None
                if kinds[a] == 0:
                    known.append(part[5].to_numpy().view(np.uint64)), counts.append(part[6].to_numpy())
                    continue
                if table_ is None:
                    all_words = np.concatenate(known)
                    order = np.argsort(all_words)
                    table_ = all_words[order], np.concatenate(counts)[order]
                flat, lengths = tokens_of(part[4].to_pylist())
                c = table_[1][np.searchsorted(table_[0], flat)].astype(float)
                w = vocabulary.of(flat)
                first = np.cumsum(lengths) - lengths
                logp = m.log_scores(contexts_of(w, lengths, start), w) / log10
                base = np.log10(c + 1)
                logp += np.where(w == vocabulary.other, base - other_floor, 0.0)
                sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base - floor, logp)]
                yield [part[2], part[3], lengths, sums[0], np.full(len(lengths), n, np.int64), sums[1], sums[2]]

    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    known = materialise(local.drop("n").join(totals, "word"))
    discard(local, totals)  # the files of the join go before the texts are shuffled
    word_rows = known.select("block", F.lit(0).alias("kind"), nothing("long", "doc_id"), nothing("boolean", "held"), nothing("string", "text"), "word", "n")
    text_rows = dealt.select("block", F.lit(1).alias("kind"), "doc_id", "held", "text", nothing("long", "word"), nothing("long", "n"))
    together = word_rows.union(text_rows).repartition(n_blocks, "block").sortWithinPartitions("block", "kind")
    return arrow_stream(together, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", *together.columns)


def op4_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
