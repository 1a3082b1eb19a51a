"""Personal and business identifiers: checks, detection, overlap resolution, masking and restoring.

``detect`` unites several recognisers: the patterns, identifiers with checksum and context, IBAN, payment cards, and any
plugged-in one. The patterns are resolved together with identifiers first, so that an identifier also suppresses, say, a
phone number on its digits; then identifiers, IBAN and cards come from recognisers of their own, with a review flag.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import arrow_rows

# Categories with group and priority.
TAXONOMY = {
    "IIN": ("personal", 100), "BIN": ("service", 100), "IIN_OR_BIN": ("personal", 95), "QR_CODE": ("visual", 94),
    "BARCODE": ("visual", 93), "PAYMENT_CARD": ("financial", 96), "EMAIL": ("personal", 90), "PHONE": ("personal", 90),
    "IBAN": ("financial", 90), "ADDRESS": ("personal", 85), "AMOUNT": ("financial", 80), "DOC_ID": ("service", 75),
    "ORG": ("service", 70), "PERSON": ("personal", 60), "LOCATION": ("personal", 55), "DATE": ("context", 50),
    "FACE": ("visual", 55), "SEAL": ("visual", 55), "SIGNATURE": ("visual", 55), "MANUAL": ("personal", 100),
}
# Patterns by category with confidence and priority; the group named value is the span.
UPPER, LOWER = "А-ЯӘҒҚҢӨҰҮҺЁІ", "а-яәғқңөұүһёі"
NAME = rf"(?:[{UPPER}A-Z][{LOWER}a-z'’\-]{{1,40}}|[{UPPER}A-Z]{{2,40}})"
INITIALS = rf"[{UPPER}A-Z]\.\s*[{UPPER}A-Z]\.?"
PERSON = rf"(?:{NAME}\s+{INITIALS}|{NAME}(?:\s+{NAME}){{1,2}})"
FORM = r"(?:ТОО|ЖШС|АО|АҚ|ИП|ЖК|ГУ|ММ|КГУ|КММ|РГУ|РММ|ГККП|МКҚК|РГП|РМК|КГП|КМК|ОО|ҚБ|ОФ|ҚҚ|ПК|ӨК)"
PATTERNS = (
    ("EMAIL", 0.98, 90, r"(?<![\w.-])(?P<value>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)(?![\w.-])"),
    ("PHONE", 0.96, 90, r"(?<!\d)(?P<value>(?:\+?7|8)[\s()\-]*\d{3}[\s()\-]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2})(?!\d)"),
    ("ADDRESS", 0.94, 85, r"(?im)(?<!электронный\s)(?<!электронная\s)(?<!электрондық\s)\b(?:юридический\s+адрес|фактический\s+адрес|адрес(?:\s+(?:места\s+(?:жительства|регистрации)|местонахождения|проживания))?|место\s+проживания|мекенжай(?:ы)?|тұрғылықты\s+жер(?:інің)?(?:\s+мекенжайы)?|тіркелген\s+жерінің\s+мекенжайы)\b[ \t]*[:—–-][ \t]*(?P<value>[^\n;]{3,180}?)(?=\s+(?:тел(?:ефон)?|phone|e-?mail|электрон(?:дық|ная)\s+(?:пошта|почта)|ИИН|ЖСН|БИН|БСН)\s*[:.-]|[;\n]|$)"),
    ("ADDRESS", 0.86, 85, rf"(?im)(?P<value>\b(?:(?:Республика\s+Казахстан|Қазақстан\s+Республикасы)\s*,\s*)?(?:(?:г(?:ород)?\.?\s*)?[{UPPER}][\w'’\-]+|[{UPPER}][\w'’\-]+\s+(?:облысы|ауданы|қаласы))(?:\s+(?:область|облысы|район|ауданы|город|қаласы|қ\.))?\s*,\s*[^\n;]{{0,120}}?(?:ул(?:ица)?\.?|көшесі|к-сі|проспект|пр-т|даңғылы|мкр\.?|микрорайон|шағын\s+аудан|ықшам\s+аудан)[^\n;]{{1,100}}?(?:\b(?:д(?:ом)?|үй|кв(?:артира)?|пәтер|офис|кеңсе|строение)\b\s*[:№.\-]?\s*|,\s*)\d+[A-Za-zА-Яа-яӘәҒғҚқҢңӨөҰұҮүҺһІі]?(?:[^\n;]{{0,60}}))"),
    ("PERSON", 0.90, 60, rf"(?<!\w)(?i:Ф\.?\s*И\.?\s*О\.?|граждан(?:ин|ка)|азамат(?:ша)?|заявитель|өтініш\s+беруші)(?!\w)(?:\s*[:—–-]\s*|\s+)(?P<value>{PERSON})"),
    ("PERSON", 0.90, 60, rf"(?<!\w)(?i:фамилия\s*,?\s*имя\s*,?\s*отчество|тегі\s*,?\s*аты\s*,?\s*әкесінің\s+аты)(?!\w)[ \t]*(?:\([^\n)]{{1,80}}\)[ \t]*)?[:—–-][ \t]*(?P<value>{PERSON})"),
    ("PERSON", 0.88, 60, rf"(?<!\w)(?i:директор|руководитель|басшы|председатель|төраға|подписал(?:а)?|қол\s+қойған|представитель|өкіл|судья|нотариус)[ \t]*(?:[:—–-][ \t]*)?(?P<value>{NAME}[ \t]+{INITIALS})"),
    ("IBAN", 0.98, 90, r"(?i)(?P<value>\bKZ\d{2}[A-Z0-9]{16}\b)"),
    ("DATE", 0.90, 50, r"(?<!\d)(?P<value>(?:0?[1-9]|[12]\d|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)\d{2})(?!\d)"),
    ("DOC_ID", 0.94, 75, r"(?i)\b(?:договор|контракт|приказ|акт|сч[её]т)\b[ \t]*(?:№|no\.?|#)[ \t]*(?P<value>[A-ZА-ЯӘҒҚҢӨҰҮҺІ0-9][\w./-]{1,})"),
    ("DOC_ID", 0.90, 75, r"(?i)\b(?:договор|контракт|приказ|акт|сч[её]т)\b[ \t]*(?P<value>\d[\w./-]{1,})"),
    ("ORG", 0.92, 70, rf"(?P<value>\b{FORM}(?:\s+на\s+ПХВ|\s+ШЖҚ)?\s+(?:[«\"][^»\"\n]{{2,120}}[»\"]|[{UPPER}A-Z][^\n,;]{{2,100}}))"),
    ("ORG", 0.92, 70, rf"(?P<value>[«\"][^»\"\n]{{2,120}}[»\"]\s*{FORM}\b)"),
    ("ORG", 0.92, 70, r"(?i)(?P<value>\b(?:товарищество\s+с\s+ограниченной\s+ответственностью|акционерное\s+общество|жауапкершілігі\s+шектеулі\s+серіктестігі|акционерлік\s+қоғам)\s+[«\"][^»\"\n]{2,120}[»\"])"),
    ("ORG", 0.86, 70, rf"(?i)(?P<value>\b(?:министерство|комитет|департамент|управление)\s+[^\n,;]{{2,100}}?(?:Республики\s+Казахстан|(?:города|области|района)\s+[{UPPER}][\w'’\-]+))"),
    ("ORG", 0.86, 70, rf"(?P<value>\b(?:Қазақстан\s+Республикасының\s+)?[{UPPER}][\w'’\-]+(?:\s+[{UPPER}{LOWER}][\w'’\-]+){{0,7}}\s+(?:министрлігі|комитеті|департаменті|басқармасы))\b"),
    ("ORG", 0.86, 70, rf"(?P<value>\b[{UPPER}][\w'’\-]+(?:\s+[{UPPER}][\w'’\-]+)?\s+(?:облысының|қаласының|ауданының)\s+(?:әкімдігі|мәслихаты|соты|прокуратурасы))\b"),
    ("ORG", 0.86, 70, rf"(?i)(?P<value>\b(?:акимат|прокуратура|маслихат|суд)\s+(?:города|области|района)\s+[{UPPER}][\w'’\-]+(?:[ \t]+[{UPPER}][\w'’\-]+)?)"),
    ("IIN", 0.99, 100, r"(?i)(?:ИИН|ЖСН|IIN|индивидуальный\s+идентификационный\s+номер|жеке\s+сәйкестендіру\s+нөмірі)\s*[:№#-]?\s*(?P<value>\d(?:[ \t-]?\d){11})(?!\d)"),
    ("BIN", 0.99, 100, r"(?i)(?:БИН|БСН|BIN|бизнес-идентификационный\s+номер|бизнес-сәйкестендіру\s+нөмірі)\s*[:№#-]?\s*(?P<value>\d(?:[ \t-]?\d){11})(?!\d)"),
    ("IIN_OR_BIN", 0.99, 100, r"(?i)(?:ИИН\s*/\s*БИН|ЖСН\s*/\s*БСН|ИИН\s*\(БИН\)|ЖСН\s*\(БСН\))\s*[:№#-]?\s*(?P<value>\d(?:[ \t-]?\d){11})(?!\d)"),
    ("BARE_ID", 0.0, 95, r"(?<!\d)(?P<value>\d{12})(?!\d)"),
    ("PAYMENT_CARD", 0.98, 96, r"(?<!\d)(?P<value>(?:\d[ -]?){12,18}\d)(?!\d)"),
)
# Amounts, address rules, stop phrases, context words, weights, placeholders and replacement labels.
AMOUNT_TAIL = r"(?i)(?:[.,]\d+)?\s*(?:(?:₸|₽|\$|€)(?!\w)|(?:тенге|руб(?:лей|ля)?|KZT|RUB|USD|EUR)\b)"
ADDRESS_MAIL = r"(?i)[\w.+-]+@[\w-]+(?:\.[\w-]+)+\.?"
ADDRESS_WORD = r"(?i)\d|\b(?:ул(?:ица)?|көшесі|к-сі|проспект|пр-т|даңғылы|мкр|микрорайон|дом|үй|квартира|пәтер|офис|кеңсе)\b"
ADDRESS_SUFFIX = r"(?:,\s*|\s{2,})(?:(?i:тел(?:ефон)?|phone|e-?mail|электрон(?:дық|ная)\s+(?:пошта|почта))|(?:ТОО|ЖШС|АО|АҚ|ГУ|ММ|КГУ|КММ|РГУ|РММ))\b"
ID_CONTEXT = {
    "IIN": ("иин", "жсн", "iin", "заявитель", "азамат", "өтініш"),
    "BIN": ("бин", "бсн", "bin", "компания", "ұйым", "заңды тұлға"),
    "IIN_OR_BIN": ("иин/бин", "жсн/бсн"),
}
TEXT_GROUPS = ("personal", "financial", "service", "context")
PLACEHOLDER, ANY_PLACEHOLDER = r"\[[A-Z][A-Z_]+_[0-9]+\]", r"\[[A-Za-z][A-Za-z_-]*[_-][0-9]+\]"
LABELS = {
    "PERSON": "Гражданин", "ADDRESS": "Адрес", "ORG": "Организация", "IIN": "ИИН скрыт", "IIN_OR_BIN": "ИИН/БИН скрыт",
    "QR_CODE": "QR-код скрыт", "BARCODE": "Штрихкод скрыт", "PAYMENT_CARD": "Карта скрыта", "EMAIL": "Email скрыт",
    "PHONE": "Телефон скрыт", "IBAN": "Счёт скрыт", "AMOUNT": "Сумма скрыта", "BIN": "БИН скрыт", "DOC_ID": "Номер скрыт",
    "FACE": "Лицо скрыто", "SEAL": "Печать скрыта", "SIGNATURE": "Подпись скрыта", "LOCATION": "Место скрыто", "DATE": "Дата скрыта",
}
OTHER_LABEL, NUMBERED = "Скрыто", ("PERSON", "ADDRESS", "ORG")
CARD_CONTEXT = r"(?i)\b(?:card|карта|карты|банк картасы|номер карты|pan)\b"
STOP_PERSONS = ("акционерное общество", "общие положения", "республика казахстан", "северный казахстан", "физическое лицо", "заңды тұлға")
WEIGHTS, SECOND_WEIGHTS = tuple(range(1, 12)), (3, 4, 5, 6, 7, 8, 9, 10, 11, 1, 2)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _digit_array(digits: Column) -> Column:
    return F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), 0), lambda d: d.cast("int"))


def valid_card(text: Column) -> Column:
    """13 to 19 digits, not all the same, that pass Luhn; separators are ignored."""
    d = digits_only(text)
    return F.length(d).between(13, 19) & (F.size(F.array_distinct(_digit_array(d))) > 1) & F.call_function("luhn_check", d)


def valid_identifier(text: Column) -> Column:
    """Twelve digits, not all the same, whose last is the weighted sum modulo 11, with second weights when that is 10."""
    d = _digit_array(digits_only(text))

    def check(weights):
        products = F.zip_with(F.slice(d, 1, 11), F.array(*map(F.lit, weights)), lambda a, b: F.coalesce(a * b, F.lit(0)))
        return F.aggregate(products, F.lit(0), lambda s, v: s + v) % 11

    first = check(WEIGHTS)
    final = F.when(first == 10, check(SECOND_WEIGHTS)).otherwise(first)
    return (F.size(d) == 12) & (F.size(F.array_distinct(d)) > 1) & (final != 10) & (final == F.element_at(d, -1))


def identifier_class(text: Column) -> Column:
    """BIN when digits 3 and 4 are a month and digit 5 is above 3, else IIN; null if invalid."""
    d = digits_only(text)
    is_bin = F.substring(d, 3, 2).cast("int").between(1, 12) & ~F.substring(d, 5, 1).isin("0", "1", "2", "3")
    return F.when(valid_identifier(text), F.when(is_bin, "BIN").otherwise("IIN"))


def valid_iban(text: Column) -> Column:
    """KZ, two digits, sixteen letters or digits, remainder 1 modulo 97."""
    s = F.upper(F.regexp_replace(text, r"\s+", ""))
    moved = F.concat(F.expr("''"), F.substring(s, 5, 16), F.substring(s, 1, 4))
    values = F.transform(F.regexp_extract_all(moved, F.lit("."), 0), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda r, v: F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97))
    return s.rlike("^KZ[0-9]{2}[A-Z0-9]{16}$") & (rest == 1)


SPAN = "struct<start:int,end:int,category:string,group:string,confidence:double,priority:int,source:string,review_required:boolean>"
FAILURE = "struct<detector:string,message:string>"
IDENTIFIERS = ("IIN", "BIN", "IIN_OR_BIN")


#: What no span of a category can be without: most texts lack it, and their patterns need not run. All others need Cyrillic.
NEEDS = {"EMAIL": "at"} | dict.fromkeys(("PHONE", "IBAN", "DATE", "IIN", "BIN", "BARE_ID"), "digit")
SIGNS = {"at": re.compile("@"), "digit": re.compile(r"\d"), "cyrillic": re.compile("[\u0400-\u04ff]")}


#: Where a match can begin, ignoring case as patterns do (dotless and dotted i, the Kelvin sign, small Cyrillic variants are
#: letters then): most texts have few such places, and a pattern is tried at them alone. All others begin a Cyrillic word.
STARTS = {
    "PHONE": "[+78]", "IBAN": "[Kk\u212a][Zz]", "DATE": r"\d+", "BARE_ID": r"\d+", "PAYMENT_CARD": r"\d+", "ORG_QUOTED": "[«\"]", "IIN_OR_BIN": "[ИиЖж]",
    "IIN": "[IiİıИиЖж](?:(?<=[ИиЖж])|[Iiİı][Nn])", "BIN": "[BbБб](?:(?<=[Бб])|[Iiİı][Nn])", "CYRILLIC": "[\u0400-\u04ff\u1c80-\u1c88]+",
}


@lru_cache(maxsize=1)
def _compiled():
    return [(c, conf, prio, re.compile(p)) for c, conf, prio, p in PATTERNS]


@lru_cache(maxsize=1)
def _starts():
    return {kind: re.compile(p) for kind, p in STARTS.items()}


def _kind(category: str, pattern: re.Pattern) -> str:
    return category if category in STARTS else "EMAIL" if category == "EMAIL" else "ORG_QUOTED" if pattern.pattern.startswith("(?P<value>[«") else "CYRILLIC"


def _places(kind: str, text: str) -> list[int]:
    """Places of a text, in order, one of which every match of a pattern of that kind begins at."""
    if kind != "EMAIL":
        return [m.start() for m in _starts()[kind].finditer(text)]
    out, at = [], text.find("@")
    while at >= 0:  # the run of an address before the sign, and what follows a plus in it
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        out += [start, *(i + 1 for i in range(start, at) if text[i] == "+")] if start < at else []
        at = text.find("@", at + 1)
    return out


def matches(pattern: re.Pattern, places: list[int], text: str) -> list[re.Match]:
    """What ``finditer`` gives of a pattern whose matches begin at these places."""
    out, done = [], 0
    for i in places:
        if i >= done and (m := pattern.match(text, i)):
            out.append(m)
            done = m.end()
    return out


def disjoint(spans: Iterable[dict], length: int) -> list[dict]:
    """Greedy choice by priority, confidence, length, start and category among the spans inside the text, by start."""
    starts, kept = [], {}
    for s in sorted((s for s in spans if 0 <= s["start"] < s["end"] <= length), key=lambda s: (-s["priority"], -s["confidence"], s["start"] - s["end"], s["start"], s["category"])):
        i = bisect_left(starts, s["end"])  # the kept ones before i start before this one ends
        if i == 0 or kept[starts[i - 1]]["end"] <= s["start"]:
            insort(starts, s["start"])
            kept[s["start"]] = s
    return [kept[i] for i in starts]


def from_left(spans: Iterable[dict], length: int) -> list[dict]:
    """The other choice, for masking: by start, length, confidence and category, each beyond the one before."""
    out = []
    for s in sorted((s for s in spans if 0 <= s["start"] < s["end"] <= length), key=lambda s: (s["start"], s["start"] - s["end"], -s["confidence"], s["category"])):
        if not out or s["start"] >= out[-1]["end"]:
            out.append(s)
    return out


def _checksum_class(digits: str) -> str | None:
    d = [int(c) for c in digits if c.isdigit()]
    if len(d) != 12 or len(set(d)) == 1:
        return None
    for weights in (WEIGHTS, SECOND_WEIGHTS):
        rest = sum(a * b for a, b in zip(d, weights)) % 11
        if rest != 10:
            break
    if rest != d[11]:
        return None
    return "BIN" if 1 <= d[2] * 10 + d[3] <= 12 and d[4] > 3 else "IIN"


def _passes_luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()]
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def _span(start: int, end: int, category: str, confidence: float, priority: int, source: str, review: bool = False) -> dict:
    return {"start": start, "end": end, "category": category, "group": TAXONOMY[category][0], "confidence": confidence, "priority": priority, "source": source, "review_required": review}


def amounts(text: str) -> list[tuple[int, int]]:
    """Numbers before a currency: one pass over the runs of digits and white space."""
    tail, out, done = re.compile(AMOUNT_TAIL), [], 0
    for run in re.finditer(r"\d[\d\s]*+", text):
        if run.start() < done or not (after := tail.match(text, run.end())):
            continue
        start = run.start()
        if start and re.match(r"\w", text[start - 1]):  # glued to a word: the next number of the run begins it
            inner = re.compile(r"\s(?=\d)").search(text, start, run.end())
            if not inner:
                continue
            start = inner.end()
        done = after.end()
        out.append((start, done))
    return out


def _person(value: str) -> str:
    return "" if value.casefold() in STOP_PERSONS else value


def _address(value: str) -> str:
    """The value up to a contact or company that follows it, if that leaves something; nothing where it is no address."""
    place = re.split(ADDRESS_SUFFIX, value, maxsplit=1)[0]
    if 3 <= len(place) < len(value):
        value = place.rstrip(" ,")
    return value if re.search(ADDRESS_WORD, value) and not re.fullmatch(ADDRESS_MAIL, value) else ""


#: What counts of a value found by a category's patterns; of the others all.
COUNTS = {"PERSON": _person, "ADDRESS": _address}


def _number(m: re.Match, category: str, priority: int) -> list[dict]:
    """A number of twelve digits by its checksum: sure if it holds; a bare one counts only then, and less."""
    kind = _checksum_class(m["value"])
    if category == "BARE_ID" and not kind:
        return []
    sure = (0.90 if kind == "BIN" else 0.84) if category == "BARE_ID" else 0.99 if kind else 0.86
    named = category if category in ("IIN", "BIN") else kind or category
    return [_span(*m.span("value"), named, sure, priority, "identifier", sure < 0.9)]


def _value(m: re.Match, category: str, confidence: float, priority: int) -> list[dict]:
    """A value without the white space around it, as far as its category lets it count."""
    start, end = m.span("value")
    value = COUNTS.get(category, str)(m["value"].strip())
    start += len(m["value"]) - len(m["value"].lstrip())
    return [_span(start, start + len(value), category, confidence, priority, "pattern")] if value else []


def pattern_spans(text: str, groups: Iterable[str] = TEXT_GROUPS) -> list[dict]:
    """All pattern candidates of a text whose category is in ``groups``, identifiers included; overlaps are not resolved."""
    there = {need for need, sign in SIGNS.items() if sign.search(text)}
    out = [_span(a, b, "AMOUNT", 0.95, 80, "pattern") for a, b in amounts(text)] if "digit" in there else []
    places: dict[str, list[int]] = {}
    for category, confidence, priority, pattern in _compiled():
        if category == "PAYMENT_CARD" or NEEDS.get(category, "cyrillic") not in there:
            continue
        if (kind := _kind(category, pattern)) not in places:
            places[kind] = _places(kind, text)
        for m in matches(pattern, places[kind], text):
            out += _number(m, category, priority) if category in (*IDENTIFIERS, "BARE_ID") else _value(m, category, confidence, priority)
    return [s for s in out if s["group"] in groups]


def _in_context(text: str, s: dict) -> dict:
    """An identifier with one of its words from 60 characters before to 30 after is surer by 0.1, up to 0.99."""
    near = text[max(0, s["start"] - 60) : s["end"] + 30].casefold()
    return s | {"confidence": min(0.99, s["confidence"] + 0.1)} if s["confidence"] < 0.99 and any(w in near for w in ID_CONTEXT[s["category"]]) else s


def _pattern_of(category: str) -> re.Pattern:
    return next(p for c, _, _, p in _compiled() if c == category)


def _ibans(text: str) -> list[dict]:
    pattern = _pattern_of("IBAN")
    found = [(m.start("value"), m.end("value"), _valid_iban(m["value"])) for m in matches(pattern, _places("IBAN", text), text)]
    return [_span(a, b, "IBAN", 0.99 if good else 0.72, TAXONOMY["IBAN"][1], "iban", not good) for a, b, good in found]


def _valid_iban(value: str) -> bool:
    value = value.upper()
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1 if re.fullmatch(r"KZ[0-9]{2}[A-Z0-9]{16}", value) else False


def _cards(text: str) -> list[dict]:
    pattern = _pattern_of("PAYMENT_CARD")
    out = []
    for m in matches(pattern, _places("PAYMENT_CARD", text), text):
        good = _passes_luhn(m[0])
        if good or re.search(CARD_CONTEXT, text[max(0, m.start() - 45) : m.end() + 20]):
            out.append(_span(*m.span(), "PAYMENT_CARD", 0.98 if good else 0.70, TAXONOMY["PAYMENT_CARD"][1], "card", not good))
    return out


def rule_spans(text: str, groups: Iterable[str] = TEXT_GROUPS) -> list[dict]:
    """Spans of the built-in recognisers, before the last resolution. Other groups' candidates are gone before they can
    take the place of any: a span that a company's name would cover is found where companies are not asked for."""
    candidates = pattern_spans(text, groups)
    patterns = [s for s in disjoint(candidates, len(text)) if s["category"] not in (*IDENTIFIERS, "IBAN", "PAYMENT_CARD")]
    identifiers = disjoint([s for s in candidates if s["source"] == "identifier"], len(text))
    numbers = [*_ibans(text), *_cards(text)] if SIGNS["digit"].search(text) else []
    return [*patterns, *[_in_context(text, s) for s in identifiers], *[s for s in numbers if s["group"] in groups]]


class DetectionIncomplete(RuntimeError):
    """A recogniser failed where all must have run."""


def detect_text(text: str, recognisers: dict[str, Callable] | None = None, groups: Iterable[str] = TEXT_GROUPS, fail_closed: bool = False) -> tuple[list[dict], list[dict]]:
    """(spans, failures) of one text. A plugged-in recogniser gives (start, end, category, confidence) tuples; what it raises is
    a failure of at most 240 characters, or an error where ``fail_closed``."""
    spans, failures, groups = [], [], set(groups)
    for name, find in {"rules": None, **(recognisers or {})}.items():
        try:
            spans += rule_spans(text, groups) if find is None else [_span(a, b, c, conf, TAXONOMY[c][1], name, True) for a, b, c, conf in find(text)]
        except Exception as e:  # noqa: BLE001  whatever a recogniser raises belongs to its text
            failures.append({"detector": name, "message": (str(e).strip() or type(e).__name__)[:240]})
    if failures and fail_closed:
        raise DetectionIncomplete("; ".join(f"{f['detector']}: {f['message']}" for f in failures))
    return disjoint([s for s in spans if s["group"] in groups], len(text)), failures


def detect(docs: DataFrame, id_column: str = "doc_id", recognisers: dict[str, Callable] | None = None, groups: Iterable[str] = TEXT_GROUPS, fail_closed: bool = False, kept: Iterable[str] = ()) -> DataFrame:
    """(id, spans, failures, complete, and the columns ``kept``): candidates and overlaps are resolved in one worker call a text."""
    groups, kept = tuple(groups), list(kept)

    def run(key, text, *more):
        spans, failures = detect_text(text or "", recognisers, groups, fail_closed)
        return key, spans, failures, not failures, *more

    schema = ", ".join([f"{id_column} long, spans array<{SPAN}>, failures array<{FAILURE}>, complete boolean", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]])
    return arrow_rows(docs.select(F.col(id_column).cast("long").alias(id_column), "text", *kept), run, schema, [id_column, "text", *kept])


def mask_spans(texts: list[str], spans: list[list[dict]]) -> tuple[list[str], dict[str, str]]:
    """The texts of one session with each span as ``[CATEGORY_n]``, and the value of each token; n counts first uses of a value
    (white space collapsed, case folded) in its category over all texts."""
    known, values, counts, out = {}, {}, {}, []
    for text, found in zip(texts, spans):
        parts, at = [], 0
        for s in from_left(found, len(text)):
            value = text[s["start"] : s["end"]]
            key = s["category"], re.sub(r"\s+", " ", value).strip().casefold()
            if key not in known:
                counts[s["category"]] = counts.get(s["category"], 0) + 1
                known[key] = f"[{s['category']}_{counts[s['category']]}]"
                values[known[key]] = value
            parts += [text[at : s["start"]], known[key]]
            at = s["end"]
        out.append("".join(parts) + text[at:])
    return out, values


def mask_documents(docs: DataFrame, recognisers: dict[str, Callable] | None = None) -> DataFrame:
    """(doc_id, masked, tokens, entity_count, categories): all detected spans of each document masked; fails where a recogniser does."""

    def run(key, text):
        spans, _ = detect_text(text or "", recognisers, fail_closed=True)
        (masked,), values = mask_spans([text or ""], [spans])
        per = {}
        for token in values:
            category = token[1 : token.rindex("_")]
            per[category] = per.get(category, 0) + 1
        return key, masked, list(values.items()), len(values), sorted(per.items())

    return arrow_rows(docs, run, "doc_id long, masked string, tokens map<string,string>, entity_count int, categories map<string,int>", ["doc_id", "text"])


def restore_tokens(text: Column, tokens: Column) -> Column:
    """The text with its tokens as their values, the longest token first; a placeholder without a value is an error."""
    unknown = F.array_except(F.regexp_extract_all(text, F.lit(ANY_PLACEHOLDER), 0), F.map_keys(tokens))
    ordered = F.array_sort(F.map_entries(tokens), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    restored = F.aggregate(ordered, text, lambda s, t: F.replace(s, t["key"], t["value"]))
    return F.when(F.size(unknown) > 0, F.raise_error(F.lit("unknown privacy placeholder"))).otherwise(restored)


def replacement_labels(findings: DataFrame) -> DataFrame:
    """(doc_id, id, label): the label of each finding's category, with A, B, ... by first use of a value for people, addresses, organisations.

    ``findings`` has doc_id, id, place (their order), category and text; findings without text are values of their own.
    """
    from ..functions.text import alphabetic_suffix

    value = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    keyed = findings.withColumn("_value", F.when(value != "", value).otherwise(F.concat(F.lit("\x00"), F.col("id").cast("string"))))
    firsts = keyed.groupBy("doc_id", "category", "_value").agg(F.min("place").alias("_first"))
    firsts = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("_first", "_value")))
    names = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("category")), F.lit(OTHER_LABEL))
    label = F.when(F.col("category").isin(*NUMBERED), F.concat(names, F.lit(" "), alphabetic_suffix(F.col("_n")))).otherwise(names)
    return keyed.join(firsts, ["doc_id", "category", "_value"]).select("doc_id", "id", label.alias("label"))


def mask(texts: DataFrame, pattern: str, category: str) -> DataFrame:
    """(key, text) to (key, masked, tokens): each match becomes ``[CATEGORY_n]``, one n per folded value in order of first use."""
    found = F.regexp_extract_all("text", F.lit(pattern), 0)
    folded = F.transform(found, lambda v: F.lower(F.trim(F.regexp_replace(v, r"\s+", " "))))
    token = lambda i: F.concat(F.lit(f"[{category}_"), i.cast("string"), F.lit("]"))
    marked = texts.withColumn("_values", found).withColumn("_folded", folded).withColumn("_order", F.array_distinct("_folded"))
    pieces = F.split("text", pattern, -1)
    names = F.transform("_folded", lambda v: token(F.array_position("_order", v)))
    woven = F.array_join(F.flatten(F.zip_with(pieces, names, lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")
    firsts = F.transform("_order", lambda v: F.get("_values", F.array_position("_folded", v).cast("int") - 1))
    return marked.withColumn("masked", F.coalesce(woven, F.col("text"))).withColumn("tokens", firsts).drop("_values", "_folded", "_order")


def restore(masked: Column, tokens: Column, category: str) -> Column:
    """The text with its tokens replaced by their values, the longest token first."""
    return F.aggregate(F.sequence(F.size(tokens), F.lit(0), F.lit(-1)), masked, lambda s, i: F.when(i > 0, F.replace(s, F.concat(F.lit(f"[{category}_"), i.cast("string"), F.lit("]")), F.coalesce(F.get(tokens, i - 1), F.lit("")))).otherwise(s))


def unknown_tokens(text: Column, tokens: Column, category: str) -> Column:
    """Placeholders of the text that no value stands behind."""
    known = F.transform(F.sequence(F.lit(0), F.size(tokens)), lambda i: F.concat(F.lit(f"[{category}_"), i.cast("string"), F.lit("]")))
    return F.array_except(F.regexp_extract_all(text, F.lit(rf"\[{category}_[0-9]+\]"), 0), known)
