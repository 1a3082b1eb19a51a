"""Every query of the library by name over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, evidence, jobs, layout, privacy, reports, retrieval
from .plans import pipelines
from .session import ship, table
from .sources import stores

QUESTIONS = [(1, "the edthe thing station"), (2, "der einheit zu und"), (3, "que elle dans les"), (4, "invoice number and date")]
NOW = "2024-01-15 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ship(spark), lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_COUNT = "len(regexp_extract_all(coalesce({0}, ''), '{1}'))::BIGINT"
_SEEN = r"regexp_replace(text, '\s', '', 'g')"
_N_ALNUM, _N_SUSPICIOUS, _N_TOKENS = _COUNT.format(_SEEN, r"[\p{L}\p{N}]"), _COUNT.format(_SEEN, r"[\p{Cc}\x{FFFD}]"), _COUNT.format("text", r"[\p{L}\p{Nl}\p{No}]+")
_N_MIXED = r"len(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nl}\p{No}]+'), lambda t: regexp_matches(t, '\p{Cyrillic}') AND regexp_matches(t, '\p{Latin}')))::BIGINT"
_PROFILE = f"p AS (SELECT doc_id, source, {_N_ALNUM} AS a, coalesce(length({_SEEN}), 0)::BIGINT AS v, {_N_SUSPICIOUS} AS s, {_COUNT.format(_SEEN, "[\\x{FFFD}\\x00]")} AS r, {_N_TOKENS} AS t, {_N_MIXED} AS m FROM documents)"
_SIGNAL = "(a >= 30 AND v > 0 AND r / v < 0.1)"

#: The chunker as a recursive query.
_CHUNKS = r"""
  w AS (
    SELECT doc_id, lang, text, length(text) AS n, 0 AS start, least(1600, length(text)) AS stop, 0 AS i
    FROM (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents) WHERE length(text) > 0
    UNION ALL
    SELECT doc_id, lang, text, n, greatest(cut - 150, start + 1), least(greatest(cut - 150, start + 1) + 1600, n), i + 1
    FROM (
      SELECT *, CASE WHEN stop >= n THEN n WHEN nl >= 800 THEN start + nl WHEN sp >= 800 THEN start + sp ELSE stop END AS cut FROM (
        SELECT *, CASE WHEN strpos(reverse(substring(text, start + 1, stop - start)), chr(10)) > 0 THEN stop - start - strpos(reverse(substring(text, start + 1, stop - start)), chr(10)) ELSE -1 END AS nl,
                  CASE WHEN strpos(reverse(substring(text, start + 1, stop - start)), ' ') > 0 THEN stop - start - strpos(reverse(substring(text, start + 1, stop - start)), ' ') ELSE -1 END AS sp FROM w))
    WHERE cut < n),
  x AS (
    SELECT doc_id, lang, i, regexp_replace(substring(text, start + 1, cut - start), '^\s+|\s+$', '', 'g') AS text FROM (
      SELECT *, CASE WHEN stop >= n THEN n WHEN nl >= 800 THEN start + nl WHEN sp >= 800 THEN start + sp ELSE stop END AS cut FROM (
        SELECT *, CASE WHEN strpos(reverse(substring(text, start + 1, stop - start)), chr(10)) > 0 THEN stop - start - strpos(reverse(substring(text, start + 1, stop - start)), chr(10)) ELSE -1 END AS nl,
                  CASE WHEN strpos(reverse(substring(text, start + 1, stop - start)), ' ') > 0 THEN stop - start - strpos(reverse(substring(text, start + 1, stop - start)), ' ') ELSE -1 END AS sp FROM w))),
  c AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, text FROM x WHERE text <> '')
"""
_TERMS = r"""
  t AS (
    SELECT doc_id, chunk_index, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS term FROM c),
  k AS (SELECT * FROM t WHERE length(term) > 2)
"""
_Q = "q AS (SELECT DISTINCT question_id, term FROM (SELECT question_id, lower(unnest(regexp_extract_all(question, '[\\p{L}\\p{N}_]+'))) AS term FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS) + ") AS v(question_id, question)) WHERE length(term) > 2)"
_BM25 = f"""
  {_Q},
  l AS (SELECT doc_id, chunk_index, count(*) AS len FROM k GROUP BY ALL),
  n AS (SELECT c.doc_id, count(*) AS n, greatest(coalesce(sum(len), 0) / count(*), 1) AS mean FROM c LEFT JOIN l ON c.doc_id = l.doc_id AND c.chunk_index = l.chunk_index GROUP BY c.doc_id),
  f AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM k WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  d AS (SELECT doc_id, term, count(*) AS df FROM f GROUP BY ALL),
  s AS (
    SELECT q.question_id, f.doc_id, f.chunk_index,
           round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
    FROM f JOIN q USING (term) JOIN d USING (doc_id, term) JOIN n USING (doc_id) JOIN l USING (doc_id, chunk_index) GROUP BY ALL)
"""


def _chunks(read):
    return chunking.chunk_facts(chunking.chunk_documents(read("documents"), "lang"))


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id int, question string")


@query(f"SELECT doc_id, {_COUNT.format('text', '[\\p{L}\\p{N}_]+')} AS word_count, coalesce(length({_STRIP}), 0)::BIGINT AS char_count FROM documents")
def text_metrics(spark, read):
    t = F.col("text")
    return read("documents").select("doc_id", T.word_count(t).alias("word_count"), T.char_count(t).alias("char_count"))


@query(f"WITH {_PROFILE} SELECT doc_id, a AS n_alnum, v AS n_visible, s AS n_suspicious, t AS n_tokens FROM p")
def char_profile(spark, read):
    p = T.profile(F.col("text"))
    return read("documents").select("doc_id", *[p[k].alias(k) for k in ("n_alnum", "n_visible", "n_suspicious", "n_tokens")])


@query(f"WITH {_PROFILE} SELECT doc_id, m AS n_mixed FROM p")
def script_mix(spark, read):
    return read("documents").select("doc_id", T.mixed_script_tokens(F.col("text")).alias("n_mixed"))


@query(f"WITH {_PROFILE} SELECT doc_id, {_SIGNAL} AND a / v >= 0.55 AND s / v < 0.02 AND (t = 0 OR m / t < 0.10) AS reliable FROM p")
def native_text_gate(spark, read):
    return read("documents").select("doc_id", T.native_text_reliable(T.profile(F.col("text"))).alias("reliable"))


_LOW = f"NOT {_SIGNAL} OR (v >= 30 AND a / v < 0.55) OR (s >= 2 AND s / v >= 0.02) OR (m >= 2 AND m / t >= 0.03)"


@query(f"WITH {_PROFILE} SELECT doc_id, CASE WHEN {_LOW} THEN 'low' WHEN source = 'src0' THEN 'medium' ELSE 'high' END AS quality FROM p")
def page_quality(spark, read):
    method = F.when(F.col("source") == "src0", "ocr").otherwise("native")
    quality, _ = T.page_quality(T.profile(F.col("text")), method, F.lit("unknown"))
    return read("documents").select("doc_id", quality.alias("quality"))


@query(f"""WITH {_PROFILE} SELECT source, CASE WHEN bool_or({_LOW}) THEN 'low' WHEN source = 'src0' THEN 'medium' ELSE 'high' END AS quality,
  count(*) FILTER ({_LOW}) AS low_pages, count(*) AS pages FROM p GROUP BY source""")
def quality_rollup(spark, read):
    method = F.when(F.col("source") == "src0", "ocr").otherwise("native")
    quality, _ = T.page_quality(T.profile(F.col("text")), method, F.lit("unknown"))
    pages = read("documents").select("source", quality.alias("q"), method.alias("m"))
    low, ocr = F.col("q") == "low", F.col("m") == "ocr"
    return pages.groupBy("source").agg(F.when(F.bool_or(low), "low").when(F.bool_or(ocr), "medium").otherwise("high").alias("quality"), F.count_if(low).alias("low_pages"), F.count("*").alias("pages"))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, text FROM c")
def chunks(spark, read):
    return _chunks(read).select("doc_id", "chunk_index", "text")


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, sum(length(text))::BIGINT AS char_count, sum({_COUNT.format('text', '[\\p{L}\\p{N}_]+')})::BIGINT AS word_count FROM c GROUP BY doc_id")
def chunk_stats(spark, read):
    return _chunks(read).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("char_count").alias("char_count"), F.sum("word_count").alias("word_count"))


def _source_chunks(read):
    """Chunks of all documents of a source as one document with several languages."""
    docs = read("documents").select("doc_id", "source")
    return _chunks(read).join(docs, "doc_id").withColumn("chunk_index", F.col("doc_id") * 1000 + F.col("chunk_index")).drop("doc_id").withColumnRenamed("source", "doc_id")


_SOURCE_SHARES = """g AS (SELECT source, c.lang, sum(greatest(length(c.text), 1)) AS n, min(c.doc_id * 1000 + chunk_index) AS first_chunk FROM c JOIN documents d USING (doc_id) GROUP BY source, c.lang),
  h AS (SELECT source, lang, round(n / sum(n) OVER (PARTITION BY source), 4) AS share, first_chunk FROM g)"""


@query(f"WITH RECURSIVE {_CHUNKS}, {_SOURCE_SHARES} SELECT source, lang, share FROM h")
def language_distribution(spark, read):
    return chunking.language_distribution(_source_chunks(read)).select(F.col("doc_id").alias("source"), "lang", "share")


@query(f"WITH RECURSIVE {_CHUNKS}, {_SOURCE_SHARES} SELECT source, lang AS primary_language FROM h QUALIFY row_number() OVER (PARTITION BY source ORDER BY share DESC, first_chunk) = 1")
def primary_language(spark, read):
    return chunking.primary_language(chunking.language_distribution(_source_chunks(read))).withColumnRenamed("doc_id", "source")


@query(f"WITH RECURSIVE {_CHUNKS}, {_SOURCE_SHARES} SELECT lang, round(sum(share), 4) AS total FROM h GROUP BY lang")
def language_totals(spark, read):
    return chunking.language_totals(chunking.language_distribution(_source_chunks(read)))


@query(f"WITH RECURSIVE {_CHUNKS}, {_TERMS} SELECT doc_id, chunk_index, term, count(*) AS tf FROM k GROUP BY ALL")
def term_freq(spark, read):
    return retrieval.term_frequency(_chunks(read))


@query(f"WITH RECURSIVE {_CHUNKS}, {_TERMS} SELECT doc_id, term, count(DISTINCT chunk_index) AS df FROM k GROUP BY ALL")
def doc_freq(spark, read):
    return retrieval.document_frequency(retrieval.term_frequency(_chunks(read)))


@query(f"WITH RECURSIVE {_CHUNKS}, {_TERMS}, {_BM25} SELECT * FROM s")
def bm25_scores(spark, read):
    return retrieval.bm25(_chunks(read), _questions(spark))


@query(f"WITH RECURSIVE {_CHUNKS}, {_TERMS}, {_BM25} SELECT question_id, doc_id, chunk_index, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY score DESC, chunk_index) AS rank FROM s) WHERE rank <= 5")
def bm25_topk(spark, read):
    return retrieval.top_chunks(retrieval.bm25(_chunks(read), _questions(spark)))


_DUE = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  z AS (SELECT a.vec_id AS question_id, b.vec_id AS item, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"""


def _due(read, k=None):
    e = read("embeddings").select(F.col("vec_id").alias("item"), "embedding")
    return retrieval.similar(e, e.filter("item % 20 = 0").withColumnRenamed("item", "question_id"), k)


@query(f"WITH {_DUE} SELECT question_id, item, score FROM z QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item) <= 5")
def cosine_topk(spark, read):
    ranked = retrieval.top_chunks(_due(read, retrieval.TOP).select("question_id", F.lit(0).alias("doc_id"), F.col("item").alias("chunk_index"), "score"))
    return ranked.select("question_id", F.col("chunk_index").alias("item"), "score")


@query(f"""WITH {_DUE}, y AS (SELECT z.question_id, item, (label + 0.0)::DOUBLE - 1 AS score FROM z JOIN embeddings ON vec_id = item),
  ra AS (SELECT question_id, item, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item) AS r FROM z),
  rb AS (SELECT question_id, item, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item) AS r FROM y WHERE score > 0)
  SELECT question_id, item, round(coalesce(1 / (60 + ra.r)::DOUBLE, 0) + coalesce(1 / (60 + rb.r)::DOUBLE, 0), 9) AS rrf FROM ra FULL JOIN rb USING (question_id, item)""")
def rrf_fusion(spark, read):
    e = read("embeddings").select(F.col("vec_id").alias("item"), "embedding", (F.col("label") - 1).cast("double").alias("lexical"))
    asked = e.filter("item % 20 = 0").select(F.col("item").alias("question_id"), "embedding")
    return retrieval.fuse_similar(e, asked)


_CARDS = r"SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{13,19}')) AS number FROM documents"


@query(f"""WITH m AS ({_CARDS}), u AS (SELECT doc_id, number, list_transform(range(length(number)), lambda i: number[(length(number) - i)::INTEGER]::INTEGER * (1 + i % 2)) AS d FROM m)
  SELECT doc_id, number, list_sum(list_transform(d, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10 = 0 AND len(list_distinct(string_split(number, ''))) > 1 AS valid FROM u""")
def luhn_cards(spark, read):
    m = read("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), 0)).alias("number"))
    return m.select("doc_id", "number", privacy.valid_card(F.col("number")).alias("valid"))


def _sql_check(weights):
    return "(" + " + ".join(f"number[{i + 1}]::INTEGER * {w}" for i, w in enumerate(weights)) + ") % 11"


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, lpad((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31)::VARCHAR, 12, '9') AS number FROM lineitem),
  u AS (SELECT *, CASE WHEN {_sql_check(privacy.WEIGHTS)} = 10 THEN {_sql_check(privacy.SECOND_WEIGHTS)} ELSE {_sql_check(privacy.WEIGHTS)} END AS r FROM m)
  SELECT l_orderkey, l_linenumber, CASE WHEN r = number[12]::INTEGER AND r <> 10 AND len(list_distinct(string_split(number, ''))) > 1 THEN
    CASE WHEN number[3:4]::INTEGER BETWEEN 1 AND 12 AND number[5] NOT IN ('0', '1', '2', '3') THEN 'BIN' ELSE 'IIN' END END AS kind FROM u""")
def kz_identifier(spark, read):
    number = F.lpad((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31).cast("string"), 12, "9")
    return read("lineitem").select("l_orderkey", "l_linenumber", privacy.identifier_class(number).alias("kind"))


_EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"


@query(rf"SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS email FROM documents")
def pii_email(spark, read):
    return read("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_EMAIL), 0)).alias("email"))


@query()
def pii_spans(spark, read):
    return privacy.detect(read("documents")).select("doc_id", F.inline("spans"))


@query()
def pii_counts(spark, read):
    spans = privacy.detect(read("documents")).select("doc_id", F.inline("spans"))
    return spans.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


_MASKED = rf"""WITH RECURSIVE s AS (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') AS v FROM documents),
  o AS (SELECT doc_id, text, v, list_transform(v, lambda x: lower(x)) AS f FROM s),
  d AS (SELECT *, list_filter(f, lambda x, i: list_position(f, x) = i) AS u FROM o),
  r AS (
    SELECT doc_id, text AS rest, '' AS done, 0 AS i, v, f, u FROM d
    UNION ALL
    SELECT doc_id, substring(rest, strpos(rest, v[i + 1]) + length(v[i + 1])), done || substring(rest, 1, strpos(rest, v[i + 1]) - 1) || '[EMAIL_' || list_position(u, f[i + 1]) || ']', i + 1, v, f, u FROM r WHERE i < len(v))"""


@query(f"{_MASKED} SELECT doc_id, done || rest AS masked, len(u)::INTEGER AS n_tokens FROM r WHERE i = len(v)")
def mask_text(spark, read):
    return privacy.mask(read("documents").select("doc_id", "text"), _EMAIL, "EMAIL").select("doc_id", "masked", F.size("tokens").alias("n_tokens"))


@query(f"SELECT doc_id, lower(text) AS restored, len(list_distinct(regexp_extract_all(lower(text), '{_EMAIL}')))::INTEGER AS n_tokens FROM documents")
def mask_roundtrip(spark, read):
    lowered = read("documents").select("doc_id", F.lower("text").alias("text"))  # one spelling a value, so restoring is exact
    m = privacy.mask(lowered, _EMAIL, "EMAIL")
    return m.select("doc_id", privacy.restore(F.col("masked"), F.col("tokens"), "EMAIL").alias("restored"), F.size("tokens").alias("n_tokens"))


@query()
def mask_documents(spark, read):
    """All detected spans masked and restored again: the restored text is the text."""
    docs = read("documents").select("doc_id", "text")
    m = privacy.mask_documents(docs)
    return m.select("doc_id", "masked", "entity_count", privacy.restore_tokens(F.col("masked"), F.col("tokens")).alias("restored"))


@query("SELECT n, CASE WHEN n <= 26 THEN chr((64 + n)::INTEGER) WHEN n <= 702 THEN chr((64 + (n - 1) // 26)::INTEGER) || chr((65 + (n - 1) % 26)::INTEGER) END AS suffix FROM (SELECT p_partkey % 702 + 1 AS n FROM part GROUP BY 1)")
def pseudonym_labels(spark, read):
    return read("part").select((F.col("p_partkey") % 702 + 1).alias("n")).distinct().select("n", T.alphabetic_suffix(F.col("n")).alias("suffix"))


def _cited(read):
    """Every chunk states a number and cites itself twice: by its own text and by that of the chunk before it."""
    chunks = _chunks(read).withColumn("extraction_quality", F.when(F.col("lang") == "en", "high").otherwise("medium")).withColumn("uncertain_region_count", F.lit(0))
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    cited = chunks.withColumn("before", before).select("doc_id", "chunk_index", (F.col("doc_id") * 100_000 + F.col("chunk_index")).alias("conclusion_id"), F.concat(F.lit("about "), (F.col("chunk_index") % 10).cast("string"), F.lit(" of it")).alias("observation"), F.explode(F.array_compact(F.array("text", "before"))).alias("quote"))
    return cited, chunks


_FORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CITED = rf"""b AS (SELECT *, doc_id * 100000 + chunk_index AS conclusion_id, 'about ' || chunk_index % 10 || ' of it' AS observation, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM c),
  e AS (SELECT *, text AS quote FROM b UNION ALL SELECT *, before AS quote FROM b WHERE before IS NOT NULL),
  j AS (SELECT *, {_FORM.format('quote')} <> '' AND contains({_FORM.format('text')}, {_FORM.format('quote')}) AS text_matched FROM e)"""


@query(f"WITH RECURSIVE {_CHUNKS}, {_CITED} SELECT conclusion_id, doc_id, text_matched FROM j")
def citation_match(spark, read):
    return evidence.match_citations(*_cited(read)).select("conclusion_id", "doc_id", "text_matched")


@query(f"""WITH RECURSIVE {_CHUNKS}, {_CITED} SELECT conclusion_id, bool_or(NOT text_matched OR lang <> 'en') OR
  len(list_filter(regexp_extract_all(any_value(observation), '[0-9]+(?:[.,][0-9]+)*'), lambda x: NOT list_contains(flatten(list(CASE WHEN text_matched THEN regexp_extract_all(quote, '[0-9]+(?:[.,][0-9]+)*') ELSE [] END)), x))) > 0 AS requires_review FROM j GROUP BY conclusion_id""")
def requires_review(spark, read):
    cited, chunks = _cited(read)
    return evidence.requires_review(cited.select("conclusion_id", "observation").distinct(), evidence.match_citations(cited, chunks))


_FOUND = r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|[0-9][0-9 ()-]{8,}[0-9]"


@query(rf"""WITH f AS (SELECT doc_id, text, unnest(list_concat(regexp_extract_all(text, '{_FOUND}'), ['not in any text', 'ab'])) AS finding FROM documents)
  SELECT doc_id, finding FROM f WHERE length(regexp_replace(finding, '\s+', '', 'g')) >= 3 AND contains(lower(regexp_replace(text, '\s+', '', 'g')), lower(regexp_replace(finding, '\s+', '', 'g')))""")
def residual_text(spark, read):
    docs = read("documents")
    found = F.concat(F.regexp_extract_all("text", F.lit(_FOUND), 0), F.array(F.lit("not in any text"), F.lit("ab")))
    return evidence.residual_text(docs.select("doc_id", F.explode(found).alias("text")), docs).select("doc_id", F.col("text").alias("finding"))


@query(f"""WITH RECURSIVE {_CHUNKS}, p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM c)
  SELECT doc_id, chunk_index, coalesce(list_max(list_filter(range(20, 151), lambda k: before IS NOT NULL AND k <= length(before) AND k <= length(text) AND ends_with(before, text[1:k]))), 0)::INTEGER AS overlap FROM p""")
def overlap_trim(spark, read):
    return chunking.trim_overlaps(_chunks(read)).select("doc_id", "chunk_index", "overlap")


@query(f"""WITH RECURSIVE {_CHUNKS}, g AS (
    SELECT doc_id, chunk_index, length(text) AS size, 0 AS batch FROM c WHERE chunk_index = 0
    UNION ALL
    SELECT c.doc_id, c.chunk_index, CASE WHEN size + 2 + length(c.text) > 6500 THEN length(c.text) ELSE size + 2 + length(c.text) END, batch + CASE WHEN size + 2 + length(c.text) > 6500 THEN 1 ELSE 0 END
    FROM g JOIN c ON c.doc_id = g.doc_id AND c.chunk_index = g.chunk_index + 1)
  SELECT doc_id, chunk_index, batch FROM g""")
def greedy_batches(spark, read):
    return chunking.greedy_batches(_chunks(read))


@query("SELECT p_partkey, array_to_string(CASE WHEN p_size <= 3 THEN list_transform(range(1, p_size + 1), lambda x: x::INTEGER) ELSE [1, round_even((p_size - 1) / 2.0, 0)::INTEGER + 1, p_size::INTEGER] END, ',') AS pages FROM part")
def page_sample(spark, read):
    return read("part").select("p_partkey", F.array_join(F.transform(T.even_sample(F.col("p_size"), 3), lambda x: x.cast("string")), ",").alias("pages"))


def _library(read):
    quality = read("labels").select("doc_id", "quality")
    docs = read("documents").select("doc_id", F.col("source").alias("owner"), F.col("n_chars").alias("size_bytes"), "lang", "text")
    return docs.join(quality, "doc_id", "left").withColumn("status", F.when(F.col("quality") == 1, "processed").when(F.col("quality") == 0, "failed").otherwise("uploaded"))


_LIBRARY = "b AS (SELECT doc_id, source AS owner, n_chars AS size_bytes, lang, text, CASE quality WHEN 1 THEN 'processed' WHEN 0 THEN 'failed' ELSE 'uploaded' END AS status FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"WITH {_LIBRARY} SELECT owner, count(*) AS total_documents, count(*) FILTER (status = 'processed') AS processed_documents, count(*) FILTER (status = 'failed') AS failed_documents, coalesce(sum(size_bytes), 0)::BIGINT AS storage_bytes FROM b GROUP BY owner")
def dashboard_summary(spark, read):
    return reports.dashboard(_library(read))


@query("SELECT owner, sum(size_bytes)::BIGINT AS storage_bytes FROM (SELECT source AS owner, n_chars AS size_bytes FROM documents UNION ALL SELECT 'src' || page_id % 20, length(html) FROM pages) GROUP BY owner")
def storage_usage(spark, read):
    files = read("pages").select(F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("owner"), F.length("html").alias("size_bytes"))
    return reports.storage(_library(read).select("owner", "size_bytes"), files)


@query(f"WITH {_LIBRARY} SELECT doc_id, owner, status FROM b WHERE status = 'processed' AND (contains(lower(owner), 'rc1') OR contains(lower(lang), 'rc1') OR contains(lower(status), 'rc1') OR contains(lower(doc_id::VARCHAR), 'rc1') OR contains(lower(size_bytes::VARCHAR), 'rc1') OR contains(lower(text), 'rc1') OR contains('application/pdf', 'rc1'))")
def library_search(spark, read):
    return reports.library_search(_library(read).withColumn("content_type", F.lit("application/pdf")), "  RC1 ", ["owner", "lang", "status", "doc_id", "size_bytes", "text", "content_type"], F.col("status") == "processed").select("doc_id", "owner", "status")


def _orders_as_jobs(read):
    return read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50) OR o_orderstatus = 'P'")
def recent_jobs_or_active(spark, read):
    return reports.recent_or_active(_orders_as_jobs(read), F.col("status") == "P").select("id", "status")


@query("SELECT o_custkey AS owner, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, read):
    return reports.latest_per_key(_orders_as_jobs(read), ["owner"], ["created_at", "id"]).select("owner", "id")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def last_n_history(spark, read):
    return reports.last_n(read("conversations"), ["conv_id"], "turn", 4).select("conv_id", "turn", "role")


def _events_as_jobs(read):
    e = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.element_at(F.array(*map(F.lit, ["pending", "running", "retry_scheduled", "completed"])), (F.col("event_id") % 4 + 1).cast("int"))
    wait = F.when(F.col("event_id") % 4 == 2, F.col("ts") + F.expr("interval 30 seconds"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("queue"), status.alias("status"), wait.alias("not_before"), F.col("ts").alias("started_at"), F.col("ts").alias("created_at"), (F.col("event_id") % 5).cast("int").alias("attempts"))


@query(f"""WITH j AS (SELECT event_id AS id, user_id AS queue, ts, event_id % 4 AS s, (event_id % 5)::INTEGER AS attempts FROM events)
  SELECT id, queue, attempts, CASE WHEN s = 1 THEN 'restarting' ELSE 'starting' END AS stage FROM j WHERE s = 0 OR (s = 2 AND ts + INTERVAL 30 SECOND <= TIMESTAMP '{NOW}') OR (s = 1 AND ts < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND)
  QUALIFY row_number() OVER (PARTITION BY queue ORDER BY ts, id) = 1""")
def claim_next(spark, read):
    return jobs.claim_next(_events_as_jobs(read), F.lit(NOW).cast("timestamp")).select("id", "queue", "attempts", "stage")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(spark, read):
    e = read("events").withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return jobs.dedupe_first(e, "key", ["ts", "event_id"]).select("event_id", "user_id")


@query("SELECT event_id, greatest(least(5 * pow(2, event_id % 5), 60), 1)::DOUBLE AS delay FROM events")
def retry_schedule(spark, read):
    return read("events").select("event_id", jobs.retry_delay(F.col("event_id") % 5 + 1).alias("delay"))


@query(f"SELECT event_id AS id FROM events WHERE event_id % 4 = 1 AND ts < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND")
def stale_reclaim(spark, read):
    return _events_as_jobs(read).filter((F.col("status") == "running") & jobs.runnable(F.lit(NOW).cast("timestamp"))).select("id")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 900 SECOND THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
  SELECT user_id, session, count(*) AS touches FROM n GROUP BY ALL""")
def sessions(spark, read):
    return jobs.sessionize(read("events"), "user_id", "ts").select("user_id", "session", "touches")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
  s AS (SELECT event_id, user_id, event_type, n, [us] AS log, true AS allowed, 0::BIGINT AS wait FROM o WHERE n = 1
    UNION ALL SELECT event_id, user_id, event_type, n, CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE greatest(1, (86400000000 - (us - live[1]) + 999999) // 1000000) END
    FROM (SELECT o.*, list_filter(s.log, lambda t: o.us - t < 86400000000) AS live FROM s JOIN o ON o.user_id = s.user_id AND o.event_type = s.event_type AND o.n = s.n + 1))
  SELECT event_id, user_id AS client, event_type AS bucket, allowed, wait::INTEGER AS retry_after FROM s""")
def rate_limit(spark, read):
    return jobs.rate_limit(read("events").select("event_id", F.col("user_id").alias("client"), F.col("event_type").alias("bucket"), "ts"), limit=3, window=86400)


def _all_words(read):
    """Every word of every document, keyed by page and place: no place reaches 2 ** 31, so no two words share a key."""
    w = read("documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", r"\s+")).alias("i", "text")).filter("text <> ''")
    return w.select("page_id", (F.col("page_id") * (1 << 31) + F.col("i")).alias("word_id"), "text", F.lit(0).alias("block"), F.lit(0).alias("paragraph"), (F.lit(1 << 31) - F.floor(F.col("i") / 10)).alias("line"), ((F.col("i") % 10) * 50).cast("int").alias("left"), (F.floor(F.col("i") / 10) * 20).alias("top"), F.lit(40).alias("width"), F.lit(16).alias("height"), (F.lit(40.0) + F.col("i") % 60).alias("confidence"))


_ALL_WORDS = r"""v AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, string_split_regex(text, '\s+') AS w FROM documents)),
  o AS (SELECT doc_id AS page_id, doc_id * 2147483648 + i AS word_id, t, i // 10 AS line, i % 10 * 50 AS l, i // 10 * 20 AS top, 40.0::DOUBLE + i % 60 AS conf FROM v WHERE t <> '')"""


@query(f"WITH {_ALL_WORDS}, n AS (SELECT page_id, line, string_agg(t, ' ' ORDER BY l) AS s FROM o GROUP BY ALL) SELECT page_id, string_agg(s, chr(10) ORDER BY line) AS text FROM n GROUP BY page_id")
def line_assembly(spark, read):
    return layout.assemble_lines(_all_words(read))


@query(f"WITH {_ALL_WORDS} SELECT word_id, ((top + 8) // 80 * 5 + (l + 20) // 100)::BIGINT AS cell_id FROM o")
def words_in_cells(spark, read):
    words = _all_words(read)
    pages = words.groupBy("page_id").agg(F.floor(F.max(F.col("top") + F.col("height")) / 80).alias("last"))
    cells = pages.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") * 5 + 4)).alias("k"))
    cells = cells.select("page_id", F.col("k").alias("cell_id"), (F.col("k") % 5 * 100).alias("left"), (F.floor(F.col("k") / 5) * 80).alias("top"), (F.col("k") % 5 * 100 + 100).alias("right"), (F.floor(F.col("k") / 5) * 80 + 80).alias("bottom"))
    return layout.words_in_cells(words, cells)


@query(f"WITH {_ALL_WORDS} SELECT page_id, round(sum(conf * greatest(length(t), 1)) / sum(greatest(length(t), 1)), 6) AS confidence, round(avg(CASE WHEN conf < 60 THEN 1.0::DOUBLE ELSE 0 END), 6) AS low_ratio FROM o GROUP BY page_id")
def ocr_confidence(spark, read):
    return layout.weighted_confidence(_all_words(read))


@query("SELECT c_custkey, '| ' || replace(c_name, '|', '\\|') || ' | ' || replace(c_mktsegment, '|', '\\|') || ' |' AS row FROM customer")
def markdown_table(spark, read):
    return read("customer").select("c_custkey", layout.markdown_row(F.array("c_name", "c_mktsegment")).alias("row"))


@query("SELECT p_partkey, CASE WHEN f >= 72 THEN least(300, f)::INTEGER END AS dpi FROM (SELECT p_partkey, floor(72 * sqrt(20000000.0::DOUBLE / ((p_size * 40)::DOUBLE * (p_size * 200)))) AS f FROM part)")
def adaptive_dpi(spark, read):
    return read("part").select("p_partkey", layout.adaptive_dpi((F.col("p_size") * 40).cast("double"), (F.col("p_size") * 200).cast("double")).alias("dpi"))


@query("SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'label' ELSE lang END AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def upsert_latest(spark, read):
    current = read("documents").select("doc_id", "lang")
    return stores.upsert(current, read("labels").select("doc_id", F.lit("label").alias("lang")), ["doc_id"])


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def cascade_delete(spark, read):
    gone = read("documents").filter("source = 'src0'")
    return stores.cascade_delete(gone, "doc_id", (read("labels"), "doc_id"))[0].select("doc_id", "quality")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN session_id END AS session_id, owner FROM (SELECT doc_id, source AS session_id, CASE WHEN toxic = 1 THEN lang END AS owner, CASE WHEN source < 'src15' THEN 1 ELSE 0 END AS quality FROM documents LEFT JOIN labels USING (doc_id)) WHERE quality = 1 OR owner IS NOT NULL")
def session_sweep(spark, read):
    docs = read("documents").join(read("labels"), "doc_id", "left").select("doc_id", F.col("source").alias("session_id"), F.when(F.col("toxic") == 1, F.col("lang")).alias("owner"))
    held = read("documents").select(F.col("source").alias("session_id")).distinct().withColumn("expires_at", F.when(F.col("session_id") < "src15", 2).otherwise(1))
    return stores.sweep_sessions(held, docs, F.lit(1))[1].select("doc_id", "session_id", "owner")


@query(f"""WITH RECURSIVE {_CHUNKS}, {_TERMS}, {_BM25}, z AS (SELECT doc_id, count(*) AS m FROM c GROUP BY doc_id),
  a AS (SELECT i.question_id, c.doc_id, c.chunk_index, m, coalesce(s.score, 0) AS score FROM c JOIN z USING (doc_id) CROSS JOIN (VALUES {', '.join(f'({i})' for i, _ in QUESTIONS)}) AS i(question_id) LEFT JOIN s ON s.question_id = i.question_id AND s.doc_id = c.doc_id AND s.chunk_index = c.chunk_index)
  SELECT question_id, doc_id, chunk_index, CASE WHEN m <= 5 THEN 'full_document' ELSE 'bm25' END AS method FROM a QUALIFY m <= 5 OR row_number() OVER (PARTITION BY question_id, doc_id ORDER BY score DESC, chunk_index) <= 5""")
def ask_contexts(spark, read):
    return pipelines.ask(_chunks(read), _questions(spark))


def queries():
    from . import registry_state, registry_work  # noqa: F401  register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
