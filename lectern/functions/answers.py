"""Structured answers against a nested schema: one column expression that lists every violation by its path.

A rule is a dict with ``kind``: object (``fields``, each a rule; ``closed`` forbids others), array (``items``, ``most``),
string (``least``, ``most``, ``among``), integer or number (``from``, ``to``) or boolean. ``optional`` rules may be missing,
``nullable`` ones null. Numbers as text count as numbers, text that is a number does not count as text the other way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of an analysis and the bounds of its parts.
TASKS = ("summary", "content_review", "layout_review")
CATEGORIES = ("grammar", "style", "logic", "consistency", "ocr", "layout", "accessibility", "other")
SEVERITIES = ("critical", "high", "medium", "low")
BASES = ("native_text", "ocr", "vision")
_TEXT = lambda most, least=0, **more: {"kind": "string", "least": least, "most": most} | more
FINDING = {
    "kind": "object",
    "fields": {
        "category": _TEXT(40, among=CATEGORIES), "severity": _TEXT(40, among=SEVERITIES), "page": {"kind": "integer", "from": 1}, "evidence": _TEXT(500, 1), "explanation": _TEXT(1200, 1), "suggestion": _TEXT(1200, optional=True),
        "confidence": {"kind": "number", "from": 0, "to": 1}, "basis": _TEXT(40, among=BASES), "requires_human_review": {"kind": "boolean", "optional": True},
        "evidence_verified": {"kind": "boolean", "optional": True},
    },
}
KEY_POINT = {"kind": "object", "fields": {"text": _TEXT(1000, 1), "page": {"kind": "integer", "from": 1, "optional": True, "nullable": True}, "evidence": _TEXT(500, optional=True), "evidence_verified": {"kind": "boolean", "optional": True}}}
ANALYSIS = {
    "kind": "object",
    "fields": {
        "task": _TEXT(40, among=TASKS), "overview": _TEXT(4000, 1), "verdict": _TEXT(2000, optional=True), "key_points": {"kind": "array", "most": 20, "items": KEY_POINT, "optional": True}, "findings": {"kind": "array", "most": 100, "items": FINDING, "optional": True},
        "coverage": {"kind": "object", "fields": {"pages_reviewed": {"kind": "array", "items": {"kind": "integer"}, "optional": True}, "complete": {"kind": "boolean", "optional": True}, "limitations": {"kind": "array", "most": 20, "items": _TEXT(4000), "optional": True}}},
    },
}
_NONE = "array<string>"


def _when(broken: Column, path: Column, code: str) -> Column:
    told = F.array(F.concat_ws(": ", path, F.lit(code)))
    return F.when(F.coalesce(broken, F.lit(False)), told).otherwise(F.array().cast(_NONE))


def _all(*parts: Column) -> Column:
    return F.concat(*parts) if parts else F.array().cast(_NONE)


def _type(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _bound(value: Column, fn) -> Column:
    """``fn`` of a value that is made once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), 0)


def _checked(rule: dict, path: Column):
    return lambda v: _check(v, rule, path)


def _check(v: Column, rule: dict, path: Column) -> Column:
    """Violations of a variant that is there."""
    kind, of = rule["kind"], _type(v)
    null = of.isin("VOID")
    nothing = F.array().cast(_NONE)
    if kind == "object":
        bad, inner = of != "OBJECT", _members(v, rule, path)
    elif kind == "array":
        items = F.try_variant_get(v, "$", "array<variant>")
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        each = F.flatten(F.transform(items, lambda x, i: F.when(x.isNull(), F.array(F.concat_ws(": ", at(i), F.lit("null")))).otherwise(_check(x, rule["items"], at(i)))))
        long = _when(F.size(items) > rule["most"], path, "too_long") if "most" in rule else nothing
        bad, inner = of != "ARRAY", _all(long, each)
    elif kind == "string":
        n, text = F.length(F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$", "string")
        parts = [_when(n < rule["least"], path, "too_short")] if rule.get("least") else []
        parts += [_when(n > rule["most"], path, "too_long")] if "most" in rule else []
        parts += [_when(~text.isin(*rule["among"]), path, "not_allowed")] if "among" in rule else []
        bad, inner = of != "STRING", _all(*parts)
    elif kind == "boolean":
        bad, inner = F.try_variant_get(v, "$", "boolean").isNull(), nothing
    else:
        number = F.try_variant_get(v, "$", "double")
        parts = [_when(number < rule["from"], path, "too_small")] if "from" in rule else []
        parts += [_when(number > rule["to"], path, "too_large")] if "to" in rule else []
        bad = number.isNull() | of.isin("BOOLEAN")
        bad = bad | (number != F.floor(number)) if kind == "integer" else bad
        inner = _all(*parts)
    typed = F.when(F.coalesce(bad, F.lit(True)), F.array(F.concat_ws(": ", path, F.lit(f"not_{kind}")))).otherwise(F.coalesce(inner, nothing))
    return F.when(null, nothing if rule.get("nullable") else F.array(F.concat_ws(": ", path, F.lit("null")))).otherwise(typed)


def _members(v: Column, rule: dict, path: Column) -> Column:
    held = F.map_keys(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return _bound(held, lambda names: _members_of(v, names, rule, path))


def _members_of(v: Column, names: Column, rule: dict, path: Column) -> Column:
    parts = []
    for name, inner in rule["fields"].items():
        at = F.concat(path, F.lit(f".{name}"))
        there = F.array_contains(names, name)
        absent = F.array().cast(_NONE) if inner.get("optional") else F.array(F.concat_ws(": ", at, F.lit("missing")))
        value = F.try_variant_get(v, f"$.{name}", "variant")
        parts.append(F.when(there, _bound(value, _checked(inner, at))).otherwise(absent))
    if rule.get("closed"):
        extra = F.array_sort(F.array_except(names, F.array(*map(F.lit, rule["fields"]))))
        parts.append(F.transform(extra, lambda n: F.concat(path, F.lit("."), n, F.lit(": extra"))))
    return _all(*parts)


def violations(answer: Column, rule: dict) -> Column:
    """array<string> of ``path: code`` for a JSON text; empty for a valid one. Text that is no JSON gives ``$: not_json``."""
    return _bound(F.try_parse_json(answer), lambda v: F.when(v.isNull(), F.array(F.lit("$: not_json"))).otherwise(_check(v, rule, F.lit("$"))))
