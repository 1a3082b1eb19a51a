"""URL filters: host and path rules first, then boosted trees on lexical features.

Rules are (verdict, text) pairs like ``("block", "example.com/en/")``; a rule fits its host and all subdomains where
the path starts with its own, and the longest fitting rule wins. URLs that a rule labels train the trees, which judge
the rest. All of them count: labelled URLs are dealt by a hash of the URL into four parts, two for the suffix statistics (the
shares of all URLs of a host suffix and of a first path segment that a rule blocks, with those that no rule labels), one for
the trees, one for the threshold and the accuracy that ``UrlModel`` tells, each of which gets the half of the last part that
another hash names. The trees are fitted by Spark over all rows of their part; features are put into ``BINS`` ranges before.
A URL is blocked at the least probability, in steps of 1 / ``STEPS``, whose precision on all rows of its part is ``PRECISION``, else allowed.

The labels are the rules' own, so verdicts on other URLs carry the rules over to URLs that look alike, and no more.

Defined cases: a null URL or one without ``://`` has empty host and path and is left to the trees; without labelled
URLs of both kinds the trees allow everything; repeated rows and ties give repeated results; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, ascii_lower, discard, materialise, table, texts_of
from ._gbdt import BoostedTrees

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SUFFIX_BUCKETS, PRECISION, BINS, STEPS = 1024, 0.97, 32, 1 << 14
TREES, DEPTH, RATE, FEATURES = 50, 3, 0.2, 20


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, below = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _bucket(part: Column) -> Column:
    return F.pmod(F.crc32(part), F.lit(SUFFIX_BUCKETS)).cast("int")


def features(url: str, host: str, path: str, suffix: float, segment: float) -> list[float]:
    """Lexical features of one URL."""
    n = len(url)
    shares = [c / n for c in Counter(url).values()] if n else []
    tail = url.partition("?")[2]
    segments = [s for s in path.split("/") if s]
    return [
        n, len(host), len(path), host.count("."), len(segments), sum(c.isdigit() for c in url) / max(1, n),
        -sum(p * math.log2(p) for p in shares), tail.count("=") if tail else 0, tail.count("&") + 1 if tail else 0, host.count("-"),
        "#" in url, url.startswith("https"), max(map(len, host.split("."))), max(map(len, segments), default=0), min(map(len, segments), default=0),
        sum(c in "aeiou" for c in host) / max(1, len(host)), path.endswith("/"), "." in path, suffix, segment,
    ]


@dataclass
class UrlModel:
    #: Blocked shares by bucket of the host suffix and of the first path segment.
    rates: dict[str, np.ndarray]
    trees: BoostedTrees
    threshold: float
    #: Share of the labelled URLs kept from the trees that they judge as the rules do, and their number.
    accuracy: float
    judged: int

    def score(self, urls: list[str], hosts: list[str], paths: list[str], suffixes: list[int], segments: list[int]) -> np.ndarray:
        """Probability of a block."""
        x = self.matrix(urls, hosts, paths, suffixes, segments)
        return self.trees.score(x) if len(x) else np.zeros(0)

    def matrix(self, urls, hosts, paths, suffixes, segments) -> np.ndarray:
        return np.array([features(u, h, p, self.rates["suffix"][a], self.rates["segment"][b]) for u, h, p, a, b in zip(urls, hosts, paths, suffixes, segments)], float)


def _parsed(pages: DataFrame, rules) -> DataFrame:
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    suffix, segment = F.element_at(F.split("host", r"\."), -1), F.regexp_extract("path", "^/([^/]*)", 1)
    return parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("suffix", _bucket(suffix)).withColumn("segment", _bucket(segment))


def _features(parsed: DataFrame, rates, *kept: str) -> DataFrame:
    """(x: the features as an array, and the long columns ``kept``) of every row."""

    def run(urls, hosts, paths, suffixes, segments, *more):
        x = UrlModel(rates, None, 1.0, 0.0, 0).matrix(texts_of(urls), *(c.to_pylist() for c in (hosts, paths, suffixes, segments)))
        return [x.tolist(), *more]

    return arrow_map(parsed, run, ", ".join(["x array<double>", *[f"{c} long" for c in kept]]), "url", "host", "path", "suffix", "segment", *kept)


def _trees_of(rows: DataFrame, n: int, edges: list[list[float]]) -> BoostedTrees:
    """Trees that Spark boosts over all ``n`` rows (x, y), whose features are the numbers of their ranges."""
    at = [sum((F.col("x")[j] > F.lit(e)).cast("double") for e in cut) if cut else F.lit(0.0) for j, cut in enumerate(edges)]
    ranges = rows.select(array_to_vector(F.array(*at)).alias("features"), F.col("y").cast("double").alias("label"))
    # Spark looks for splits in maxBins ** 2 rows, so in all of them here; there are no more than BINS values to split.
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, maxBins=max(BINS, math.isqrt(n) + 1), seed=1).fit(ranges)
    out = BoostedTrees(trees=TREES, depth=DEPTH)
    inner = 2**DEPTH - 1

    def put(node, i: int, level: int) -> None:
        if level == DEPTH:
            out.leaves[-1][i - inner] = node.prediction()
            return
        leaf = node.numDescendants() == 0
        if not leaf:
            j = node.split().featureIndex()
            out.features[-1][i], out.cuts[-1][i] = j, edges[j][int(node.split().threshold())]
        put(node if leaf else node.leftChild(), 2 * i + 1, level + 1)
        put(node if leaf else node.rightChild(), 2 * i + 2, level + 1)

    for tree, weight in zip(fitted.trees, fitted.treeWeights):
        out.features.append(np.zeros(inner, int)), out.cuts.append(np.full(inner, np.inf)), out.leaves.append(np.zeros(inner + 1))
        put(tree._call_java("rootNode"), 0, 0)
        out.leaves[-1] *= 2 * weight  # Spark's loss takes twice the margin
    return out


def learn_urls(pages: DataFrame, rules=RULES) -> UrlModel:
    """Fit on all URLs that the rules label."""
    blocked = F.coalesce(F.col("rule").isin([t for v, t in rules if v == "block"]), F.lit(False))
    part = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(4))
    parsed = _parsed(pages, rules).select("*", blocked.cast("long").alias("y"), part.alias("part"), F.pmod(F.xxhash64("url", F.lit(2)), F.lit(2)).alias("half"))
    known, rates = parsed.filter("rule is null or part < 2"), {}
    for name in ("suffix", "segment"):
        rates[name] = np.full(SUFFIX_BUCKETS, 0.5)
        for r in known.groupBy(name).agg(F.sum("y").alias("blocked"), F.count("*").alias("n")).collect():
            rates[name][r[name]] = (r["blocked"] + 1) / (r["n"] + 2)
    model = UrlModel(rates, BoostedTrees(TREES, DEPTH), 1.0, 0.0, 0)
    labelled = parsed.filter("rule is not null and part >= 2")
    seen = {r["part"]: r["classes"] for r in labelled.groupBy("part").agg(F.count_distinct("y").alias("classes")).collect()}
    if seen != {2: 2, 3: 2}:
        return model
    rows = materialise(_features(labelled, rates, "y", "part", "half"))
    own = rows.filter("part = 2")
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    cuts = own.agg(*[F.percentile_approx(F.col("x")[j], shares, 10_000).alias(f"c{j}") for j in range(FEATURES)]).first()
    *most, n = own.agg(*[F.max(F.col("x")[j]) for j in range(FEATURES)], F.count("*")).first()
    model.trees = _trees_of(own, n, [sorted({c for c in cuts[j] if c < most[j]}) for j in range(FEATURES)])

    def judge(x, y, half):
        p = model.trees.score(np.array(x.to_pylist(), float).reshape(-1, FEATURES))
        return [np.floor(p * STEPS).astype(int), y, half]

    steps = arrow_map(rows.filter("part = 3"), judge, "step long, y long, half long", "x", "y", "half").groupBy("half", "step").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    discard(rows)
    tuned, told = ([(r["step"], r["y"], r["n"]) for r in sorted(steps, key=lambda r: -r["step"]) if r["half"] == k] for k in (0, 1))
    hit = n = 0
    for step, y, count in tuned:
        hit, n = hit + y, n + count
        if hit / n >= PRECISION:
            model.threshold = step / STEPS
    model.threshold = max(0.5, model.threshold) if tuned else 1.0
    right = sum(y if step / STEPS >= model.threshold else count - y for step, y, count in told)
    model.judged = sum(count for *_, count in told)
    model.accuracy = right / model.judged if model.judged else 0.0
    return model


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; ``score`` is the trees' probability of a block."""
    verdicts = {text: verdict for verdict, text in rules}
    model = learn_urls(pages, rules)

    def run(ids, urls, hosts, paths, found, suffixes, segments):
        score = model.score(texts_of(urls), *(c.to_pylist() for c in (hosts, paths, suffixes, segments)))
        judged = [verdicts[f] if f is not None else "block" if model.judged and s >= model.threshold else "allow" for f, s in zip(found.to_pylist(), score)]
        return [ids, hosts, paths, found, judged, score.tolist()]

    return arrow_map(_parsed(pages, rules), run, "page_id long, host string, path string, rule string, verdict string, score double", "page_id", "url", "host", "path", "rule", "suffix", "segment")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
