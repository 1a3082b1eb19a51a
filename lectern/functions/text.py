"""Text measures as columns: words, characters, scripts, signal and page quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and thresholds of the quality rules.
WORD = r"[\p{L}\p{N}_]+"
ALNUM = r"[\p{L}\p{N}]"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SUSPICIOUS = r"[\p{Cc}\x{FFFD}]"
MIN_SIGNAL = 30
ALNUM_LEAST, SUSPICIOUS_MOST, MIXED_MOST = 0.55, 0.02, 0.10


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def strip(text: Column) -> Column:
    """White space off both ends, by Unicode."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def visible(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def word_count(text: Column) -> Column:
    return count(text, WORD)


def char_count(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)), F.lit(0)).cast("long")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def mixed_script_tokens(text: Column) -> Column:
    """Letter runs that hold both a Cyrillic and a Latin letter."""
    both = F.filter(F.regexp_extract_all(text, F.lit(LETTERS), 0), lambda t: t.rlike(r"\p{IsCyrillic}") & t.rlike(r"\p{IsLatin}"))
    return F.coalesce(F.size(both), F.lit(0)).cast("long")


def profile(text: Column) -> dict[str, Column]:
    """The counts that the quality rules use."""
    seen = visible(text)
    return {
        "n_alnum": count(seen, ALNUM),
        "n_visible": F.coalesce(F.length(seen), F.lit(0)).cast("long"),
        "n_suspicious": count(seen, SUSPICIOUS),
        "n_replaced": count(seen, r"[\x{FFFD}\x00]"),
        "n_tokens": count(text, LETTERS),
        "n_mixed": mixed_script_tokens(text),
    }


def has_signal(p: dict[str, Column]) -> Column:
    return (p["n_alnum"] >= MIN_SIGNAL) & (share(p["n_replaced"], p["n_visible"]) < 0.1) & (p["n_visible"] > 0)


def native_text_reliable(p: dict[str, Column]) -> Column:
    return has_signal(p) & (share(p["n_alnum"], p["n_visible"]) >= ALNUM_LEAST) & (share(p["n_suspicious"], p["n_visible"]) < SUSPICIOUS_MOST) & (share(p["n_mixed"], p["n_tokens"]) < MIXED_MOST)


def page_quality(p: dict[str, Column], method: Column, given: Column) -> tuple[Column, Column]:
    """(quality, codes of the reasons in order); any rule that fires makes the page low."""
    rules = {
        "no_signal": ~has_signal(p),
        "noise": (share(p["n_alnum"], p["n_visible"]) < ALNUM_LEAST) & (p["n_visible"] >= 30),
        "suspicious": (p["n_suspicious"] >= 2) & (share(p["n_suspicious"], p["n_visible"]) >= SUSPICIOUS_MOST),
        "mixed_scripts": (p["n_mixed"] >= 2) & (share(p["n_mixed"], p["n_tokens"]) >= 0.03),
    }
    start = F.when(given == "unknown", F.when(method.startswith("ocr"), "medium").otherwise("high")).otherwise(given)
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return F.when(reduce(Column.__or__, rules.values()), "low").otherwise(start), reasons


def alphabetic_suffix(n: Column) -> Column:
    """1 to A, 26 to Z, 27 to AA: bijective base 26."""
    digits = F.aggregate(
        F.sequence(F.lit(1), F.lit(7)),
        F.struct(n.cast("long").alias("left"), F.lit("").alias("out")),
        lambda a, _: F.struct(
            F.floor((a["left"] - 1) / 26).alias("left"),
            F.when(a["left"] > 0, F.concat(F.char((a["left"] - 1) % 26 + 65), a["out"])).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return digits


def spaced(n: Column, k: Column) -> Column:
    """``k`` places of 0..n-1, both ends in, evenly spaced, halves to even, each once; all of them where ``k`` reaches ``n``."""
    at = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1)), 0).cast("int"))
    return F.array_distinct(at)


def even_sample(n: Column, k: int) -> Column:
    """Up to ``k`` page numbers of 1..n, both ends in, evenly spaced, halves to even."""
    pages = F.transform(spaced(n, F.least(n, F.lit(k))), lambda i: i + 1)
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(pages)


def format_bytes(n: Column) -> Column:
    """1024s up to GB: no decimals for bytes and from 10 on, one below."""
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB")))
    power = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = n / F.pow(F.lit(1024.0), power)
    shown = F.when((value >= 10) | (power == 0), F.round(value, 0).cast("long").cast("string")).otherwise(F.format_string("%.1f", F.round(value, 1)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").otherwise(F.concat_ws(" ", shown, F.element_at(units, power + 1)))


def format_number(n: Column) -> Column:
    """Whole numbers as they are, others with two decimals and no zeros at the end."""
    return F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", F.round(n, 2)), r"\.?0+$", ""))


def language_list(shares: Column) -> Column:
    """Languages of a map to shares as ``en 60%, de 40%``: positive ones, the largest first."""
    positive = F.filter(F.map_entries(shares), lambda e: e["value"] > 0)
    ordered = F.array_sort(positive, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0))
    return F.array_join(F.transform(ordered, lambda e: F.concat(e["key"], F.lit(" "), F.floor(e["value"] * 100 + 0.5).cast("string"), F.lit("%"))), ", ")


# Cyrillic capitals that look like Latin ones, and Latin terms that must stay so.
LOOKALIKES = ("АВСЕНІКМОРТХУ", "ABCEHIKMOPTXY")
LATIN_TERMS = ("API", "HTTP", "HTTPS", "JSON", "OCR", "PDF", "REST", "SQL", "UI", "URL", "UUID", "XML")
LETTER_EDGE = "A-Za-zА-Яа-яӘәҒғҚқҢңӨөҰұҮүҺһІі"


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def disguised_term(token: Column) -> Column:
    """The Latin term that an all-Cyrillic token stands for by its looks, else null."""
    upper = F.upper(letters_only(token))
    skeleton = F.translate(upper, *LOOKALIKES)
    cyrillic = upper.rlike(r"\p{IsCyrillic}") & ~upper.rlike(r"\p{IsLatin}")
    return F.when(cyrillic & (skeleton != upper) & skeleton.isin(*LATIN_TERMS), skeleton)


def single_latin_core(text: Column) -> Column:
    """The one Latin word of two characters or more in a text that has exactly one."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9._&/-]*"), 0)
    return F.when((F.size(found) == 1) & (F.length(F.get(found, 0)) >= 2), F.get(found, 0))


def with_outer_punctuation(original: Column, core: Column) -> Column:
    """``core`` between what stands before the first and after the last letter of ``original``."""
    return F.concat(F.regexp_extract(original, f"^[^{LETTER_EDGE}]*", 0), core, F.regexp_extract(original, f"[^{LETTER_EDGE}]*$", 0))


def joined_pages(pages: Column) -> Column:
    """Stripped pages that are not blank, with blank lines between."""
    return F.array_join(F.filter(F.transform(pages, strip), lambda p: p != ""), "\n\n")


def user_name(name: Column) -> Column:
    """The normalised form of a name of 1 to 100 characters, else null."""
    trimmed = strip(name)
    return F.when(F.length(trimmed).between(1, 100), F.lower(trimmed))


def clean_filename(name: Column, most: int = 255) -> Column:
    """The last part of a path, cut to ``most`` characters before its extension; null for none."""
    last = strip(F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1))
    extension = F.regexp_extract(last, r"(?s)[^.](\.[^.]+)$", 1)
    cut = F.when((extension != "") & (F.length(extension) < most), F.concat(F.expr("''"), F.left(last, F.lit(most) - F.length(extension)), extension)).otherwise(F.left(last, F.lit(most)))
    return F.when(last.isin("", ".", ".."), None).when(F.length(last) <= most, last).otherwise(cut)


def content_type(name: Column, given: Column) -> Column:
    """The type of a PDF upload, null where the extension is another or the given type contradicts it."""
    stated = F.lower(F.trim(F.element_at(F.split(F.coalesce(given, F.lit("")), ";"), 1)))
    return F.when(F.lower(name).endswith(".pdf") & stated.isin("", "application/octet-stream", "application/pdf"), "application/pdf")


def result_name(name: Column, label: Column, key: Column) -> Column:
    """Stem with other characters as dashes, a label and the key: the file name of a result."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[^\p{L}\p{N}_.-]+", "-")
    return F.concat_ws("-", F.regexp_replace(stem, r"^[.-]+|[.-]+$", ""), label, key.cast("string"))


def stored_path(path: Column, folder: str) -> Column:
    """Absolute paths and those in the folder as they are, others below it."""
    return F.when(path.startswith("/") | path.startswith(folder + "/"), path).otherwise(F.concat_ws("/", F.lit(folder), path))


def language_codes(listed: Column) -> Column:
    """OCR languages of a list parted by commas or pluses."""
    return F.filter(F.transform(F.split(F.translate(listed, ",", "+"), r"\+"), lambda x: F.trim(x)), lambda x: x != "")


def detector_languages(listed: Column) -> Column:
    """Lower-cased, stripped, each once in order."""
    return F.array_distinct(F.filter(F.transform(F.split(listed, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def ocr_error_kind(message: Column) -> Column:
    """missing_language, not_installed, other or unknown."""
    m = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    language = m.contains("traineddata") | m.contains("failed loading language") | m.contains("error opening data file")
    missing = m.contains("tesseract") & (m.contains("not found") | m.contains("not installed"))
    return F.when(language, "missing_language").when(missing, "not_installed").when(m != "", "other").otherwise("unknown")


def retry_after(message: Column) -> Column:
    """Whole seconds that an error text asks to wait, 1 at least; null if it does not."""
    found = F.regexp_extract(message, r"(?i)(?:retry(?:Delay| in)?['\"=: ]+)(\d+)(?:\.\d+)?s", 1)
    return F.when(found != "", F.greatest(found.cast("int"), F.lit(1)))


def analysis_stage(status: Column, stage: Column) -> Column:
    return F.when(status == "processed", "completed").when(status == "failed", "failed").when(stage.isin("queued", "ocr", "quality"), stage).otherwise("extracting")


def ai_state(errors: list[Column], results: list[Column]) -> Column:
    """error, ready or none, by the first error or result that is there."""
    there = lambda cs: reduce(Column.__or__, [F.coalesce(c, F.lit("")) != "" for c in cs])
    return F.when(there(errors), "error").when(there(results), "ready").otherwise("none")


def valid_message(text: Column, most: int) -> Column:
    """The stripped text if it is not blank and the text has at most ``most`` characters, else null."""
    return F.when((F.length(text) <= most) & (strip(text) != ""), strip(text))


def points_to_mm(points: Column) -> Column:
    return F.round(points * 25.4 / 72, 1)


def pixels(points: Column, dpi: Column) -> Column:
    return F.ceil(points * dpi / 72).cast("int")


def without_keys(schema, keys=("default", "title", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems")):
    """A nested schema without the bounds that a sampler's grammar cannot hold."""
    if isinstance(schema, dict):
        return {k: without_keys(v, keys) for k, v in schema.items() if k not in keys}
    return [without_keys(v, keys) for v in schema] if isinstance(schema, list) else schema
