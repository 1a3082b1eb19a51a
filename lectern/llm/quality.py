"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (0) or abstains on a document. Expectation-maximisation over the counts of vote
patterns, at most 3 ** 8 of them and taken over all documents, estimates each rule's accuracy and the share of good
documents; the posterior probability of good replaces "all rules must pass".

The share of good documents has a Beta prior whose weight is a fixed part of the corpus, so that the expectation-maximisation
calls neither class empty, and a corpus of any share of bad documents is judged by what it holds.

Defined cases: a null or empty text has no words and fails the base; repeated rows and ties give repeated results; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SEPARATORS, WORD, arrow_map, materialise, table, texts_of

_WORDS = re.compile(WORD).findall
SYMBOLS = "#*$%&|<>"
RULES = ("length", "symbols", "duplicate_lines", "repeated_words", "word_length", "letters", "plain_words", "line_ends")
ABSTAIN = 2
#: The prior share of good documents, and its weight as a part of all documents.
PRIOR_GOOD, PRIOR_WEIGHT = 0.8, 0.1
#: What may stand around a plain word, and at the end of a line that is a sentence's end.
AROUND, CLOSING = ".,;:!?\"'()«»“”„’-…", tuple(".!?:;…\"')»”")


def measures(text: str) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words with a letter)."""
    words = _WORDS(text)
    lines = [line for line in text.split("\n") if line.strip(SEPARATORS)]
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    repeated = 0
    if len(found) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    letters = sum(map(_has_letter, words))
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, letters


def _has_letter(word: str) -> bool:
    return word[0].isalpha() or any(map(str.isalpha, word))


def _vote(good: bool, bad: bool) -> int:
    return 0 if bad else 1 if good else ABSTAIN


def votes(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat: int, letters: int, n_lines: int) -> list[int]:
    """One vote for each of RULES but the last two."""
    w, c, mean = max(1, n_words), max(1, word_chars), word_chars / max(1, n_words)
    return [
        _vote(n_words >= 80, n_words < 20),
        _vote(n_symbols < 0.02 * c, n_symbols > 0.1 * c),
        _vote(n_dup_lines == 0, n_dup_lines > 0.3 * n_lines),
        _vote(n_repeat < 0.1 * w, n_repeat > 0.4 * w),
        _vote(3 <= mean <= 9, mean < 2 or mean > 14),
        _vote(letters >= 0.9 * w, letters < 0.7 * w),
    ]


def shape_votes(text: str) -> list[int]:
    """The votes of the last two rules: words that are letters and digits but for the punctuation around them, lines that end as sentences do."""
    words = _WORDS(text)
    lines = [bare for line in text.split("\n") if (bare := line.strip(SEPARATORS))]
    plain, closed = sum(w.strip(AROUND).isalnum() for w in words), sum(line.endswith(CLOSING) for line in lines)
    w, n = max(1, len(words)), max(1, len(lines))
    return [_vote(plain >= 0.9 * w, plain < 0.6 * w), _vote(closed >= 0.6 * n, closed < 0.2 * n and n > 1)]


def learn(counts: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[float, np.ndarray]:
    """(share of good, table[class, rule, vote]) by expectation-maximisation over pattern counts.

    A rule has two accuracies: how often it votes good on good documents and bad on bad ones. Prior counts keep both
    on the right side: good documents seldom get a bad vote, bad ones get one from about every third rule.
    """
    prior = np.array([[[0.2, 46.8, 3.0]] * len(RULES), [[14.0, 33.0, 3.0]] * len(RULES)])[::-1]  # bad class first; votes bad, good, abstain
    share, table_ = PRIOR_GOOD, prior / prior.sum(axis=2, keepdims=True)
    if not counts:
        return share, table_
    v, n = np.array(list(counts)), np.array(list(counts.values()), float)
    one_hot = np.eye(3)[v]
    for _ in range(rounds):
        good = posterior(v, share, table_)
        seen = np.stack([((1 - good) * n) @ one_hot.reshape(len(v), -1), (good * n) @ one_hot.reshape(len(v), -1)]).reshape(2, len(RULES), 3)
        table_ = (seen + prior) / (seen + prior).sum(axis=2, keepdims=True)
        share = float(((good * n).sum() / n.sum() + PRIOR_GOOD * PRIOR_WEIGHT) / (1 + PRIOR_WEIGHT))
    return share, table_


def posterior(v: np.ndarray, share: float, table_: np.ndarray) -> np.ndarray:
    """Probability of good for rows of votes."""
    rules = np.arange(len(RULES))
    told = np.log(table_[1][rules, v]) - np.log(table_[0][rules, v])
    odds = np.log(share / (1 - share)) + np.where(v == ABSTAIN, 0.0, told).sum(axis=1)  # who abstains says nothing
    return 1 / (1 + np.exp(-odds))


def judge_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, the measures, base_failed, votes, quality, kept) of every document."""

    def run(ids, texts):
        rows, ballots = [], []
        for t in texts_of(texts):
            m = measures(t)
            rows.append(m[:5])
            ballots.append("".join(map(str, votes(*m, t.count("\n") + 1) + shape_votes(t))))
        columns = list(zip(*rows)) if rows else [[]] * 5
        return [ids, *map(list, columns), ballots]

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string"
    measured = materialise(arrow_map(docs, run, schema, "doc_id", "text"))
    counts = {tuple(map(int, r["votes"])): r["n"] for r in measured.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    share, rates = learn(counts)
    patterns = list(counts)
    good = posterior(np.array(patterns, int).reshape(-1, len(RULES)), share, rates)
    known = docs.sparkSession.createDataFrame([("".join(map(str, p)), float(g)) for p, g in zip(patterns, good)], "votes string, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measured.join(F.broadcast(known), "votes")
        .withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes", "quality", (~failed & (F.col("quality") >= 0.5)).alias("kept"))
    )


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))
