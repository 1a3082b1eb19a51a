"""Geometry of words, lines, cells and boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T

# Confidences, markers of company names and of scores, bounds on second readings.
HIGH, LOW = 85.0, 60.0
MARKERS = ("ао", "ao", "ип", "jsc", "llp", "тоо", "too")
NUMERIC_LABELS = ("балл", "оценка", "score")
MOST_CELLS, MOST_TARGETED = 20, 12
#: Height of the bands of a page in which words meet cells.
BAND = 160
#: Places of a text in which spans meet words.
BUCKET = 1024
#: Places of a page whose words' lengths one task sums up.
RUN = 4096


def lines_of(words: DataFrame) -> DataFrame:
    """(page_id, top, left, block, paragraph, line, text): words of each line from left to right."""
    line = words.groupBy("page_id", "block", "paragraph", "line").agg(F.array_sort(F.collect_list(F.struct("left", "word_id", "text"))).alias("w"), F.min("top").alias("top"), F.min("left").alias("left"))
    return line.withColumn("text", F.array_join(F.transform("w", lambda w: w["text"]), " ")).drop("w")


def assemble_lines(words: DataFrame) -> DataFrame:
    """(page_id, text): lines by their least top, then least left, one under the other.

    Words are shuffled once, by their page, whose lines then lie together; a page is one text, so it is one task's anyway.
    """
    pages = lines_of(words.repartition("page_id")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("top", "left", "block", "paragraph", "line", "text"))).alias("l"))
    return pages.select("page_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def words_in_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(word_id, cell_id): the one cell of its page that holds the word's centre; none if there are several.

    A word meets only the cells that reach into its horizontal band, so a long page does not pair all with all. A word_id names
    one word of its page, so it has one band, where its hits lie together and are counted without another shuffle.
    """
    x, y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    band = lambda c: F.floor(c / BAND)
    w = words.select("page_id", "word_id", x.alias("x"), y.alias("y")).withColumn("band", band(F.col("y")))
    c = cells.select("page_id", "cell_id", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1")).filter("x1 > x0 and y1 > y0")
    c = c.withColumn("band", F.explode(F.sequence(band(F.col("y0")), band(F.col("y1")))))
    hits = w.join(c, ["page_id", "band"]).filter("x >= x0 and x < x1 and y >= y0 and y < y1")
    return hits.groupBy("page_id", "band", "word_id").agg(F.count("*").alias("n"), F.min("cell_id").alias("cell_id")).filter("n = 1").select("word_id", "cell_id")


def weighted_confidence(words: DataFrame, low: float = 60.0) -> DataFrame:
    """(page_id, confidence, low_ratio): mean weighted by text length (1 at least), share of words below ``low``."""
    weight = F.greatest(F.length("text"), F.lit(1))
    return words.groupBy("page_id").agg(
        F.round(F.sum(F.col("confidence") * weight) / F.sum(weight), 6).alias("confidence"),
        F.round(F.avg((F.col("confidence") < low).cast("double")), 6).alias("low_ratio"),
    )


def candidate_score(confidence: Column, low_ratio: Column, n_alnum: Column) -> Column:
    return confidence - 40 * low_ratio + F.least(n_alnum / 50, F.lit(5.0))


def retry_reasons(confidence: Column, low_ratio: Column, signal: Column) -> Column:
    rules = {"mean_confidence_below_high_threshold": confidence < HIGH, "low_confidence_word_ratio_above_retry_threshold": low_ratio > 0.10, "insufficient_text_signal": ~signal}
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def retry_spans(words: DataFrame) -> DataFrame:
    """(page_id, line_key, words, reason): words worth reading again in Latin.

    Beside the columns of a word: word_id. A quoted run of at most four words after a company form is one span; other words
    count alone if they mix scripts, are a Latin term in Cyrillic disguise, or hold a question mark.
    """
    keys = ["page_id", "block", "paragraph", "line"]
    w = Window.partitionBy(*keys).orderBy("left", "word_id")
    opens, closes = F.col("text").rlike('^[«"“„]'), F.col("text").rlike('[»"”]$')
    letters = T.letters_only(F.col("text"))
    rows = words.withColumns({"_place": F.row_number().over(w), "_marker": F.lower(letters).isin(*MARKERS)})
    run = F.collect_list(F.struct("word_id", opens.alias("o"), closes.alias("c"))).over(w.rowsBetween(1, 4))
    quoted = rows.withColumn("_run", run).filter(F.col("_marker") & F.get("_run", 0)["o"])
    last = F.array_position(F.transform("_run", lambda x: x["c"]), F.lit(True)).cast("int")
    quoted = quoted.withColumn("_last", last).filter("_last > 0")
    spans = quoted.select(*keys, F.transform(F.slice("_run", F.lit(1), F.col("_last")), lambda x: x["word_id"]).alias("words"), F.lit("organization").alias("reason"))
    covered = spans.select("page_id", F.explode("words").alias("word_id")).distinct()
    mixed = letters.rlike(r"\p{IsCyrillic}") & letters.rlike(r"\p{IsLatin}")
    reason = F.when(mixed, "mixed_script").when(T.disguised_term(F.col("text")).isNotNull(), "protected_term").when(F.col("text").contains("?") & (letters != ""), "placeholder")
    alone = words.withColumn("reason", reason).filter("reason is not null").join(covered, ["page_id", "word_id"], "left_anti")
    return spans.unionByName(alone.select(*keys, F.array("word_id").alias("words"), "reason"))


def numeric_values(words: DataFrame) -> DataFrame:
    """(page_id, word_id): the unsure word after the first score label of each line."""
    w = Window.partitionBy("page_id", "block", "paragraph", "line").orderBy("left", "word_id")
    after = F.lead(F.struct("word_id", "confidence")).over(w)
    label = F.lower(T.letters_only(F.col("text"))).isin(*NUMERIC_LABELS)
    labelled = words.withColumn("_next", after).filter(label & (F.col("_next.confidence") < HIGH))
    first = Window.partitionBy("page_id", "block", "paragraph", "line").orderBy("left", "word_id")
    return labelled.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("page_id", F.col("_next.word_id").alias("word_id"))


def accept_numeric(text: Column, confidence: Column, original: Column) -> Column:
    return F.trim(text).rlike(r"^\d[\d.,/-]*$") & (confidence >= LOW) & (confidence >= original + 10)


def accept_latin(reason: Column, core: Column, text: Column, confidence: Column, original: Column) -> Column:
    """Whether the second reading of a span replaces the first, by the reason for it."""
    by_reason = (
        F.when(reason == "protected_term", F.upper(core).isin(*T.LATIN_TERMS))
        .when(reason == "mixed_script", confidence >= original)
        .when(reason == "placeholder", confidence >= original - 5)
        .when(reason == "organization", text.contains("?") | ((original < HIGH) & (confidence >= original + 5)))
    )
    return (confidence >= 80) & F.coalesce(by_reason, F.lit(False))


@F.pandas_udf(DoubleType())
def similarity(first: pd.Series, second: pd.Series) -> pd.Series:
    """Matching-block ratio of two readings, lower-cased, white space collapsed; no built-in gives it."""
    from difflib import SequenceMatcher

    form = lambda t: " ".join((t or "").split()).lower()
    return pd.Series([SequenceMatcher(None, form(a), form(b), autojunk=False).ratio() for a, b in zip(first, second)])


def projection_groups(positions: Column) -> Column:
    """Rounded means (halves to even) of runs of positions with gaps of at most two."""
    step = lambda acc, p: F.when((F.size(acc) > 0) & (p - F.element_at(F.element_at(acc, -1), -1) <= 2), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.array(p))))).otherwise(F.concat(acc, F.array(F.array(p))))
    runs = F.aggregate(F.array_sort(positions), F.array().cast("array<array<int>>"), step)
    return F.transform(runs, lambda r: F.bround(F.aggregate(r, F.lit(0), lambda s, x: s + x) / F.size(r), 0).cast("int"))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.trim(F.replace(F.regexp_replace(c, r"\n", " "), F.lit("|"), F.lit("\\|")))), " | "), F.lit(" |"))


def markdown_tables(cells: DataFrame) -> DataFrame:
    """(table_id, text) of cells (table_id, row, column, text, uncertain): a header row, its rule and the rows below.

    Missing cells are empty; uncertain ones end in ``[UNCERTAIN_OCR]``.
    """
    marked = F.trim(F.when(F.col("uncertain"), F.concat(F.col("text"), F.lit(" [UNCERTAIN_OCR]"))).otherwise(F.col("text")))
    size = cells.groupBy("table_id").agg((F.max("column") + 1).alias("columns"), (F.max("row") + 1).alias("rows"), F.map_from_entries(F.collect_list(F.struct(F.struct("row", "column"), marked))).alias("at"))
    cell = lambda r, c: F.coalesce(F.col("at")[F.struct(r.cast("int").alias("row"), c.cast("int").alias("column"))], F.lit(""))
    places = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    row = lambda r: markdown_row(F.transform(places("columns"), lambda c: cell(r, c)))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(places("columns"), lambda c: F.lit("---")), " | "), F.lit(" |"))
    below = F.transform(F.slice(places("rows"), F.lit(2), F.col("rows")), row)
    return size.select("table_id", F.array_join(F.concat(F.array(row(F.lit(0)), rule), below), "\n").alias("text"))


def words_in_tables(words: DataFrame, tables: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((word_id, table_id, cell_id), (table_id) that are ambiguous).

    A word belongs to the first table (by ``place``) of its page that holds its centre, borders included; there it needs
    exactly one cell that holds it, else the table cannot be told apart.
    """
    x, y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    box = [F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1")]
    band = lambda c: F.floor(c / BAND)
    banded = lambda df: df.withColumn("band", F.explode(F.sequence(band(F.col("y0")), band(F.col("y1")))))
    w = words.select("page_id", "word_id", x.alias("x"), y.alias("y")).withColumn("band", band(F.col("y")))
    held = w.join(banded(tables.select("page_id", "table_id", "place", *box)), ["page_id", "band"]).filter(inside)
    mine = held.groupBy("page_id", "word_id", "x", "y", "band").agg(F.min_by("table_id", F.struct("place", "table_id")).alias("table_id"))
    hits = mine.join(banded(cells.select("page_id", "table_id", "cell_id", *box)), ["page_id", "table_id", "band"], "left").groupBy("page_id", "word_id", "table_id").agg(F.count_if(F.coalesce(inside, F.lit(False))).alias("n"), F.min(F.when(inside, F.col("cell_id"))).alias("cell_id"))
    return hits.filter("n = 1").select("word_id", "table_id", "cell_id"), hits.filter("n <> 1").select("table_id").distinct()


def compose_pages(words: DataFrame, tables: DataFrame) -> DataFrame:
    """(page_id, text): lines of the words outside all tables, and the tables' texts, by top, left and text; blank ones left out.

    ``tables`` has page_id, table_id, place, left, top, right, bottom and text.
    """
    inside, _ = words_in_tables(words, tables, tables.withColumn("cell_id", F.lit(0).cast("long")))
    free = words.join(inside.select("word_id"), "word_id", "left_anti")
    blocks = lines_of(free).select("page_id", "top", "left", "text").unionByName(tables.select("page_id", F.col("top").cast("int").alias("top"), F.col("left").cast("int").alias("left"), "text"))
    pages = blocks.filter(F.trim("text") != "").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("top", "left", "text"))).alias("b"))
    return pages.select("page_id", F.array_join(F.transform("b", lambda b: b["text"]), "\n").alias("text"))


def capped(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` retries of each key, the first in order: the bound on second readings is the feature."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def merged_box(boxes: DataFrame, keys: list[str], margin: int = 12) -> DataFrame:
    """The box around all words of a span, widened by ``margin``, no less than 0."""
    return boxes.groupBy(*keys).agg(
        F.greatest(F.min("left") - margin, F.lit(0)).alias("left"), F.greatest(F.min("top") - margin, F.lit(0)).alias("top"),
        (F.max(F.col("left") + F.col("width")) + margin).alias("right"), (F.max(F.col("top") + F.col("height")) + margin).alias("bottom"),
    )


def tesseract_words(rows: DataFrame) -> DataFrame:
    """Rows of an OCR engine's table without blank texts and negative confidences."""
    return rows.filter((F.trim("text") != "") & (F.col("confidence") >= 0))


def word_offsets(words: DataFrame) -> DataFrame:
    """Words with ``start`` and ``end``, their place in the page's text: words in order of ``place``, a line break where block
    or line changes, else a space.

    ``words`` has doc_id, page, place (a number that a page has once), block, line and text. Offsets are running sums of
    lengths in runs of ``RUN`` places, each of which begins with a row that holds the sum of all runs before it, so words are
    shuffled once and a page of any number of words is no single task. A null text is empty.
    """
    page, kept = ["doc_id", "page"], [c for c in words.columns if c not in ("start", "end")]
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1
    rows = words.select(*kept, size.alias("_size"), F.floor(F.col("place") / RUN).alias("_run"), F.lit(False).alias("_carried"))
    earlier = Window.partitionBy(*page).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*page, "_run").agg(F.sum("_size").alias("_size"))
    carried = sums.withColumn("_size", F.sum("_size").over(earlier)).filter("_size > 0").withColumn("_carried", F.lit(True))
    within = Window.partitionBy(*page, "_run").orderBy(F.desc("_carried"), "place").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(carried, allowMissingColumns=True).withColumn("end", F.sum("_size").over(within) - 1)
    return both.filter("not _carried").select(*kept, (F.col("end") - F.col("_size") + 1).alias("start"), "end")


def page_texts(words: DataFrame) -> DataFrame:
    """(doc_id, page, text) as ``word_offsets`` counts it."""
    word = F.struct("place", "block", "line", F.coalesce("text", F.lit("")).alias("text"))
    pages = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(word)).alias("w"))
    parted = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a["text"], F.when(b.isNull(), "").when(a["block"].eqNullSafe(b["block"]) & a["line"].eqNullSafe(b["line"]), " ").otherwise("\n")))
    return pages.select("doc_id", "page", F.array_join(parted, "").alias("text"))


def scaled_words(words: DataFrame, dpi: Column) -> DataFrame:
    """OCR words with their boxes in points in place of pixels; words of any confidence stay."""
    return words.withColumns({c: F.col(c) * 72 / dpi for c in ("x0", "y0", "x1", "y1")})


def span_words(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Each pair of a span and a word of its page (of its document, where spans have no page) that overlap, once: the span's
    columns, then the word's, its offsets as word_start and word_end.

    Both sides meet in buckets of ``BUCKET`` places; a pair counts in the first bucket that both touch, so a long text pairs
    neighbours only. Empty spans and words overlap nothing.
    """
    keys = [c for c in ("doc_id", "page") if c in spans.columns]
    bucket = lambda c: F.floor(c / BUCKET)
    touched = lambda s, e: F.explode(F.sequence(bucket(s), bucket(e - 1)))
    at = [c for c in words.columns if c not in (*keys, "start", "end")]
    w = words.filter("start < end").select(*keys, F.col("start").alias("word_start"), F.col("end").alias("word_end"), *at)
    w = w.withColumn("_bucket", touched(F.col("word_start"), F.col("word_end")))
    s = spans.filter("start < end").withColumn("_bucket", touched(F.col("start"), F.col("end")))
    first = F.greatest(bucket(F.col("start")), bucket(F.col("word_start")))
    return s.join(w, [*keys, "_bucket"]).filter((F.col("word_start") < F.col("end")) & (F.col("word_end") > F.col("start")) & (F.col("_bucket") == first)).drop("_bucket")


def span_boxes(spans: DataFrame, words: DataFrame, pad: float = 1.5) -> DataFrame:
    """Box of each span: the union of the boxes of the words that it overlaps, widened by ``pad``."""
    keys = [c for c in ("doc_id", "page", "start", "end") if c in spans.columns]
    return span_words(spans.select(*keys).distinct(), words).groupBy(*keys).agg((F.min("x0") - pad).alias("x0"), (F.min("y0") - pad).alias("y0"), (F.max("x1") + pad).alias("x1"), (F.max("y1") + pad).alias("y1"))


def adaptive_dpi(width: Column, height: Column, most: int = 300, pixels: int = 20_000_000, least: int = 72) -> Column:
    """The highest resolution, ``most`` at most, whose page of points stays within the pixel budget; null where even ``least`` does not."""
    fits = F.floor(72 * F.sqrt(F.lit(float(pixels)) / (width * height)))
    return F.when(fits >= least, F.least(F.lit(most), fits)).cast("int")
