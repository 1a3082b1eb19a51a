"""Personal data: candidate spans from high-recall generators, scored by boosted trees.

Four kinds: ``email``, ``ip``, ``card``, ``phone``. Base spans follow fixed patterns and always stay. Generators
propose further, overlapping spans (numbers glued together, numbers without a country code, spelled-out e-mail
addresses); trees over format and context features score them, and those at or above the calibrated threshold of
their kind are added, best first, where nothing chosen overlaps them.

The trees learn from invented lines (``training_lines``) because no table labels personal data; the number of lines
is a parameter.

Defined cases: null and empty texts have no spans; offsets are code points, end exclusive; all scans are linear in
the text, however long; repeated rows give repeated results; an empty table gives an empty result; extra columns are
kept by ``redact_documents`` and ignored by ``detect_pii``, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, table
from ._gbdt import BoostedTrees, calibrate_threshold

KINDS = ("email", "ip", "card", "phone")
TRAINING_LINES = 4000
PRECISION = 0.97

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9+(][0-9 ().+-]{6,}")
_LOOSE_PHONE = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
_SPELLED = re.compile(r" ?[\[(](?:at|AT|@)[\])] ?")
_SPELLED_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]{1,63})+")
_GOOD = re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|card|visa|pay|credit|mail|contact|ip|host|addr|address)\b")
_BAD = re.compile(r"(?i)\b(?:order|invoice|no|nr|isbn|version|v|sku|ref|id|item|date|serial|build|section)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the fixed patterns, by kind then start. Each scan is one pass."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for chain in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(parts) - 3, 4):
            if all(_small(p[0]) for p in parts[i : i + 4]):
                out.append((1, parts[i].start(), parts[i + 3].end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping proposals of the generators, beyond the base spans; their number is linear in the text."""
    found = set()
    for run in _RUN.finditer(text):
        groups = [m.span() for m in _PART.finditer(text, run.start(), run.end())]
        for i, (start, end) in enumerate(groups):
            count = 0
            for j in range(i, len(groups)):  # a group has a digit, so 19 digits end it
                if j > i and (groups[j][0] - groups[j - 1][1] != 1 or text[groups[j - 1][1]] not in " -"):
                    break
                count += groups[j][1] - groups[j][0]
                if count > 19:
                    break
                if count >= 13:
                    found.add((2, start, groups[j][1]))
        for m in _LOOSE_PHONE.finditer(text, run.start(), run.end()):
            found.add((3, *m.span()))
    for m in _DOTTED.finditer(text):
        parts = [p.span() for p in _PART.finditer(text, *m.span())]
        if len(parts) > 4:
            found.update((1, parts[i][0], parts[i + 3][1]) for i in range(len(parts) - 3) if all(_small(text[a:b]) for a, b in parts[i : i + 4]))
    behind = 0  # each character is looked at once
    for m in _SPELLED.finditer(text):
        start, host = m.start(), _SPELLED_HOST.match(text, m.end())
        while start > behind and text[start - 1] in _LOCAL:
            start -= 1
        behind = m.end()
        if host and start < m.start():
            found.add((0, start, host.end()))
    return sorted(found)


def _bounded(digits: str) -> int:
    """The number, or a million where it is longer than six digits: groups of digits may be of any length."""
    digits = digits.lstrip("0")
    return 10**6 if len(digits) > 6 else int(digits or 0)


def _side(c: str) -> int:
    return 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context of one candidate."""
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - 30) : start], text[end : end + 15]
    digits, groups = _digits(s), [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    seps = {c for c in s if not c.isalnum()}
    return [
        kind, len(s), len(digits), len(groups), groups[0], groups[-1], max(groups), min(groups), len(seps),
        s.startswith("+"), "(" in s, luhn(digits) if kind == 2 else 0, len(set(digits)),
        _side(before[-1:] or " "), _side(after[:1] or " "), _side(before[-2:-1] or " "), _side(after[1:2] or " "),
        bool(_GOOD.search(before)), bool(_BAD.search(before)), before.endswith("."), after.startswith("."), "dot" in s.lower(),
        max(_bounded(p) for p in s.split(".")) if kind == 1 else 0, kind == 0 and s[-2:].isalpha(),
    ]


def training_lines(n: int, seed: int = 7) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Invented lines with the spans that are personal data in them."""
    rng = np.random.default_rng(seed)
    digit = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *xs: xs[rng.integers(len(xs))]

    def card(good: bool) -> str:
        body = pick("4", "5", "37", "6") + digit(14)
        body = body[:15]
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        number = body + (last if good else str((int(last) + int(rng.integers(1, 10))) % 10))
        sep = pick("", "", " ", "-")
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    def name() -> str:
        return pick("ann", "jo.li", "k7", "mail", "post", "info", "max_m", "sales-eu", "r2d2") + pick("", "", digit(1))

    def address() -> str:
        first = pick("10", "192.168", "172.16", f"{int(rng.integers(20, 255))}.{int(rng.integers(20, 255))}")
        rest = 4 - first.count(".") - 1
        return ".".join([first, *(str(int(x)) for x in rng.integers(0, 255, rest))])

    makers = [
        (2, lambda: card(True)), (None, lambda: card(False)), (None, lambda: digit(int(rng.integers(7, 24)))),
        (3, lambda: f"+{pick('1', '7', '44', '49')} ({digit(3)}) {digit(3)}-{digit(4)}"), (3, lambda: f"({digit(3)}) {digit(3)}-{digit(4)}"),
        (3, lambda: f"{digit(3)}-{digit(3)}-{digit(4)}"), (None, lambda: f"20{digit(2)}-{digit(2)}-{digit(2)} {digit(2)} {digit(4)}"),
        (None, lambda: ".".join(str(int(x)) for x in rng.integers(0, 40, int(rng.integers(5, 8))))), (None, lambda: digit(10)),
        (0, lambda: f"{name()} [at] {name()} [dot] {pick('com', 'org', 'net', 'de')}"), (0, lambda: f"{name()}(at){name()}.{pick('com', 'org', 'fr')}"),
        (None, lambda: f"{name()} (at) {digit(2)}.{digit(2)}"), (None, lambda: f"{name()} [at] {name()}.{digit(3)}"),
        (1, lambda: f"{256 + int(rng.integers(0, 9000))}.{address()}"), (None, lambda: f"{256 + int(rng.integers(0, 9000))}." + ".".join(str(int(x)) for x in rng.integers(0, 20, int(rng.integers(4, 7))))), (None, lambda: f"{digit(1)}.{digit(2)} - {digit(3)} ({digit(4)})"),
    ]
    words = "the of and la le der die on in en thing tion über para that with".split()
    out = []
    for _ in range(n):
        text, spans = " ".join(rng.choice(words, 4)), set()
        for _ in range(int(rng.integers(1, 4))):
            kind, make = makers[rng.integers(len(makers))]
            lead = pick("", "", "", *{0: ("mail ", "contact "), 1: ("host ", "ip "), 2: ("card ", "pay "), 3: ("tel: ", "call ")}[kind]) if kind is not None else pick("", "", "order ", "ref ", "no. ", "version ")
            text += " " + lead
            item = make()
            if kind is not None:
                own = item.partition(".")[2] if kind == 1 else item  # an address glued to a number that is none of its parts
                spans.add((kind, len(text) + len(item) - len(own), len(text) + len(item)))
            text += item
            if rng.random() < 0.5:
                text += pick(" ", ", ", ". ") + " ".join(rng.choice(words, 2))
        out.append((text + pick("", ".", " end"), spans))
    return out


@lru_cache(maxsize=2)
def fitted(lines: int = TRAINING_LINES) -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees and a threshold per kind, calibrated on lines that the trees have not seen. Same on every worker."""
    x, y, k, held = [], [], [], []
    for i, (text, spans) in enumerate(training_lines(lines)):
        for c in candidates(text):
            x.append(features(text, c)), y.append(c in spans), k.append(c[0]), held.append(i % 4 == 0)
    x, y, k, held = np.array(x, float), np.array(y, float), np.array(k), np.array(held)
    trees = BoostedTrees(trees=60, depth=4).fit(x[~held], y[~held])
    p = trees.score(x[held])
    return trees, tuple(max(0.5, calibrate_threshold(p[k[held] == kind], y[held][k[held] == kind], PRECISION)) for kind in range(len(KINDS)))


def find_spans(text: str | None, model=None) -> list[tuple[int, int, int, bool]]:
    """All spans of a text, (kind, start, end, base), by kind then start."""
    text = text or ""
    base = base_spans(text)
    chosen, taken = [(*s, True) for s in base], []
    for start, end in sorted((s, e) for _, s, e in base):  # disjoint cover of the base spans
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    open_ = [c for c in candidates(text) if not _hits(taken, c[1], c[2])]
    if open_:
        trees, limits = model or fitted()
        p = trees.score(np.array([features(text, c) for c in open_], float))
        for i in np.argsort(-p, kind="stable"):
            kind, start, end = open_[i]
            if p[i] >= limits[kind] and not _hits(taken, start, end):
                insort(taken, (start, end))
                chosen.append((kind, start, end, False))
    return sorted(chosen)


def _hits(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span overlaps one of the disjoint, sorted ones."""
    i = bisect_left(taken, (end, -1))
    return i > 0 and taken[i - 1][1] > start


def redact(text: str | None, spans) -> str | None:
    """The text with each span replaced by its kind in capitals and brackets; overlapping spans fold into the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def detect_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, pii_spans, redacted) of every document."""

    def run(ids, texts):
        texts = texts.to_pylist()
        found = [find_spans(t) for t in texts]
        spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in f] for f in found]
        return [ids, spans, [redact(t, f) for t, f in zip(texts, found)]]

    return arrow_map(docs, run, f"doc_id long, pii_spans {SPAN_TYPE}, redacted string", "doc_id", "text")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with redacted texts; ``n_chars`` follows where there is such a column."""
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(*columns):
        out = list(columns)
        out[at] = [redact(t, find_spans(t)) for t in columns[at].to_pylist()]
        if chars is not None:
            out[chars] = [None if t is None else len(t) for t in out[at]]
        return out

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *names)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = detect_pii(table(spark, sf_dir, "documents"))
    base = F.filter("pii_spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii_spans")).alias("spans"))
