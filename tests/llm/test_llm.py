"""The training-data operators against brute force, exact round trips and held-out accuracy, with the odd cases."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, fingerprints, lm, mixing, ngram_join, pii, quality, registry, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "b", 1), (4, "Same text here", "en", "a", 1), (4, "Same text here", "en", "a", 1), (5, "same TEXT here", None, "b", 1), (None, "x" * 5000, "en", None, 1), (6, " \t\n ", "en", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall(), key=str)


def test_mixing_odd(odd):
    plan = mixing.mix_plan(odd)
    assert plan.count() == 8 and plan.filter("copies > 2").isEmpty()
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix_plan(odd.limit(0)).count() == 0


def _brute_base(t):
    out, luhn = [], lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii_base_is_that_of_the_patterns(texts):
    odd = ["a@b.c@d.e a@@b.cc", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "4111 1111 1111 1111-", "+1 (826) 555-4081 +12", "@x.y a@b", "..@..", "+" * 50 + "1 2", "1" * 3000]
    for t in [*texts.values(), *odd]:
        assert pii.base_spans(t) == _brute_base(t)


def test_pii_adds_numbers_glued_together_and_redacts():
    t = "4465758382889437 4465758382889437 end"
    assert pii.base_spans(t) == [] and [s[:3] for s in pii.find_spans(t)] == [(2, 0, 16), (2, 17, 33)]
    assert pii.redact(t, pii.find_spans(t)) == "[CARD] [CARD] end"
    assert pii.find_spans(None) == [] and pii.redact(None, []) is None


def test_pii_query_is_that_of_the_patterns(spark, sf_dir, texts):
    kinds = ("email", "ip", "card", "phone")
    for r in pii.op2_pii(spark, sf_dir).collect():
        base = _brute_base(texts[r["doc_id"]] or "")
        said = [f"{kinds[k]}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{k}"] for k in kinds] == [sum(kinds[s[0]] == k for s in base) for k in kinds]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(",")) | {""}


def test_pii_model_adds_every_kind_on_lines_that_it_has_not_seen():
    trees, limits = pii.fitted()
    assert max(limits) < 0.999
    hits, added, due = [0] * 4, [0] * 4, [0] * 4
    for text, spans in pii.training_lines(1500, seed=99):
        base = {s[:3] for s in pii.base_spans(text)}
        found = {s[:3] for s in pii.find_spans(text) if not s[3]}
        open_ = {s for s in spans if s not in base and s in pii.candidates(text)}
        for k in range(4):
            mine = {s for s in found if s[0] == k}
            hits[k] += len(mine & spans)
            added[k] += len(mine)
            due[k] += sum(s[0] == k for s in open_)
    for k in range(4):
        assert due[k] > 20 and hits[k] >= 0.85 * added[k] and hits[k] >= 0.7 * due[k], (k, hits, added, due)


def test_pii_odd(odd):
    assert pii.detect_pii(odd).count() == 8 and pii.redact_documents(odd).columns == odd.columns


def _components(texts, width, num, den):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(lm.__dict__.get("_") or str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100)])
def test_ngram_join_finds_all_links(spark, texts, width, num, den):
    rng = np.random.default_rng(0)
    many = {d: t for d, t in texts.items() if d < 60}
    base = " ".join(f"t{i}" for i in range(120)).split()
    for k in range(60):  # near copies around the threshold, and chains of them
        w = list(base)
        for i in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            w[i] = f"x{rng.integers(40)}"
        many[1000 + k] = " ".join(w)
        many[2000 + k] = " ".join(f"s{(i + k) % 500}" for i in range(9 + k % 9))
    docs = spark.createDataFrame(list(many.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_sets(docs, width, num, den).collect()}
    assert got == _components(many, width, num, den)


def test_ngram_join_odd(odd):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_sets(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (4, 1, 4), (5, 1, 4), (6, 0, 6)} <= got
    assert ngram_join.similar_sets(odd.limit(0)).count() == 0


def test_ngram_join_counts_every_link(spark, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_SKETCHES", 5)
    monkeypatch.setattr(ngram_join, "COMPARED", 2)
    monkeypatch.setattr(ngram_join, "COLUMNS", 50)
    words = " ".join(f"t{i}" for i in range(200)).split()
    alike = [[*words[:k], f"x{k}", *words[k + 1 :]] for k in range(0, 200, 9)]
    many = {d: t for d, t in texts.items() if d < 40} | {1000 + k: " ".join(w) for k, w in enumerate([*alike, alike[0], words])}
    sets = {d: {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set() for d, w in ((d, WORD.findall((t or "").lower())) for d, t in many.items())}
    want = {d: sum(e != d and 100 * len(x & y) >= 85 * len(x | y) > 0 for e, y in sets.items()) for d, x in sets.items()}
    docs = spark.createDataFrame(list(many.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.similar_sets(docs).collect()} == want
    assert want[1000] == len(alike) + 1


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    words = [f"t{i}" for i in range(200)]
    a, near, b, c = " ".join(words), " ".join(["x", *words[1:]]), "another text of its own", "one more text without a name"
    rows = [(1, a), (1, a), (1, near), (2, near), (None, a), (3, b), (3, c), (None, b), (None, "only here"), (None, None), (4, None), (4, None), (5, " "), (2, "second of two"), (None, "twice"), (None, "twice")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = ngram_join.drop_near_duplicates(docs, 4, 85, 100)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    group = [k for k in kept if k in ((1, a), (1, near))]
    assert len(group) == 1
    kept.remove(group[0])
    assert kept == sorted([(3, b), (3, c), (0, "only here"), (0, ""), (4, ""), (4, ""), (5, " "), (2, "second of two"), (0, "twice")])


def test_lm_base_is_exact_and_the_model_beats_it(spark, sf_dir, texts):
    rows = lm.op4_lm_scores(spark, sf_dir).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tok = {d: WORD.findall(t.translate(lower)) + ["\n"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tok}
    counts: dict = {}
    for d, ws in tok.items():
        if not held[d]:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    for r in rows:
        ws = tok[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), n)
        assert r["n_known"] == sum(w in counts for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in ws), abs=1e-6)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_lm_probabilities_sum_to_one():
    model = lm.LogBilinear(np.log(np.full(7, 1 / 7)))
    contexts = np.array([[0, 1], [7, 7]])
    p = np.exp(model.log_probabilities(contexts, np.repeat([0, 1], 7), np.tile(np.arange(7), 2))).reshape(2, 7)
    assert p.sum(axis=1) == pytest.approx([1, 1], abs=1e-5)


def test_lm_scores_do_not_depend_on_the_file_split(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 60_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one, many = ({r["doc_id"]: r["score"] for r in lm.score_documents(docs.repartition(k)).collect()} for k in (1, 7))
    assert one == pytest.approx(many, rel=1e-4)


def test_lm_odd(odd):
    assert lm.score_documents(odd).count() == 8 and lm.score_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("range_bytes", [10_000, 60_000, 10**9])
def test_fingerprints_use_the_next_document(spark, sf_dir, texts, range_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = fingerprints.with_next(docs, fingerprints._fingerprint_row, fingerprints.FINGERPRINT_SCHEMA, range_bytes=range_bytes).collect()
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in rows}
    for i, d in enumerate(ids):
        e = fingerprints.edited_text(texts[d], texts[ids[(i + 1) % len(ids)]])
        assert got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[d]["n_chars"] == len(texts[d])
        assert got[d]["fingerprint"] == fingerprints.as_text(fingerprints.fingerprint(texts[d]))
    assert len(rows) == len(ids) and np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.3


def _plain_chunks(text):
    """Content-defined chunks byte by byte: the boundary rule without vectors."""
    raw, out, start, h = text.encode(), {}, 0, 0
    hashes = []
    for b in raw:
        h = ((h << 1) + int(fingerprints.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    while start < len(raw):
        end = len(raw)
        if len(raw) - start > fingerprints.LEAST:
            for e in range(start + fingerprints.LEAST, len(raw)):
                mask = fingerprints.STRICT if e <= start + fingerprints.NORMAL else fingerprints.LOOSE
                loose_ok = e == start + fingerprints.NORMAL and hashes[e - 1] & int(fingerprints.LOOSE) == 0
                if hashes[e - 1] & int(mask) == 0 or loose_ok or e == start + fingerprints.MOST:
                    end = e
                    break
        out[hashlib.blake2b(raw[start:end], digest_size=6).digest()] = end - start
        start = end
    return out


def test_fingerprint_columns_are_those_of_brute_force(spark, sf_dir, texts):
    ids = sorted(texts)[:40]
    docs = spark.createDataFrame([(d, texts[d]) for d in ids], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}

    def alike(a, b):
        return float(not a and not b) if not a or not b else sum(n for d, n in a.items() if d in b) / min(sum(a.values()), sum(b.values()))

    for i, d in enumerate(ids):
        following = texts[ids[(i + 1) % len(ids)]]
        own, after, edited = (_plain_chunks(t) for t in (texts[d], following, texts[d][: len(texts[d]) - len(texts[d]) // 2] + following[: len(texts[d]) // 2]))
        r = got[d]
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(sorted(k.hex() + format(n, "04x") for k, n in x.items())) for x in (own, edited))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((alike(own, edited), alike(own, after)))


def test_hot_and_null_ids_get_several_ranges(spark):
    rows = [(7, f"seven {i} " * 20) for i in range(60)] + [(None, f"none {i} " * 20) for i in range(60)] + [(i, f"other {i} " * 20) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.with_next(docs, lambda i, t, n, state: (i, t, n), "doc_id long, text string, following string", range_bytes=2000)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_fingerprint_is_shift_resistant(texts):
    long = max(texts.values(), key=len)
    a, b = fingerprints.fingerprint(long), fingerprints.fingerprint("some words before " + long)
    assert fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, a) == 1 and fingerprints.likeness({}, {}) == 1 and fingerprints.likeness(a, {}) == 0


def test_fingerprints_odd(odd):
    assert fingerprints.fingerprints(odd).count() == 8 and fingerprints.fingerprints(odd.limit(0)).count() == 0


def test_bpe_is_that_of_the_library(texts):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    c = bpe.codec(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})
    cases = [*list(texts.values())[:60], "", "a" * 3000, " \n\n\t x", "é" * 301, "<|endoftext|>", "日本語🙂" * 40, "zq" * 700]
    for t, ids in zip(cases, c.encode_many(cases)):
        assert ids == library.encode_ordinary(t) and c.decode(ids) == t.encode()
    assert bpe.segment_tree_merge(b"hello worlds", c.ranks) == list(c.merge_many([b"hello worlds"])[0])


def test_bpe_odd(odd):
    assert bpe.encode_digests(odd, *bpe.public_vocabulary()).filter("n_tokens = 0").count() == 2


def test_url_rules(spark):
    urls = ["https://a.com/x", "http://EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://x.net/fr/2", "http://notexample.net/de/", "nothing", None, "http://a.com", "http://h.org?x#y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judge_urls(pages).collect()}
    assert got == {0: ("a.com", "/x", "com/"), 1: ("example.com", "/en/1", "example.com/en/"), 2: ("www.example.com", "/en/1", "www.example.com/en/"), 3: ("x.net", "/fr/2", "net/fr/"), 4: ("notexample.net", "/de/", None), 5: ("", "", None), 6: ("", "", None), 7: ("a.com", "", None), 8: ("h.org", "", None)}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_query_is_that_of_sql(spark, sf_dir):
    sql = """
    WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    r(rule, spot, below) AS (VALUES ('com/', 'com', '/'), ('example.com/en/', 'example.com', '/en/'), ('www.example.com/en/', 'www.example.com', '/en/'), ('net/es/', 'net', '/es/'), ('net/fr/', 'net', '/fr/'))
    SELECT page_id, host, path, (SELECT rule FROM r WHERE (host = spot OR ends_with(host, '.' || spot)) AND starts_with(path, below) ORDER BY length(rule) DESC LIMIT 1) AS rule FROM h
    """
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    rows = url_filter.op7_url_filter(spark, sf_dir).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"]) for r in rows) == sorted(con.sql(sql).fetchall())
    verdicts = {rule: verdict for verdict, rule in url_filter.RULES}
    assert all(r["verdict"] == verdicts[r["rule"]] for r in rows if r["rule"]) and {r["verdict"] for r in rows} == {"allow", "block"}


def test_url_model_judges_urls_kept_from_it(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    model = url_filter.learn_urls(pages)
    assert model.judged > 50 and model.accuracy > 0.95


def test_quality_base_is_that_of_brute_force(spark, sf_dir, texts):
    for r in quality.op8_quality(spark, sf_dir).collect():
        t = texts[r["doc_id"]] or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        at = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = {w: at.count(w) for w in set(at)} if len(at) < 400 else __import__("collections").Counter(at)
        covered = {i + k for i, w in enumerate(at) if times[w] > 1 for k in range(3)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_bpe_query_is_that_of_the_library(spark, sf_dir, texts):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    for r in bpe.op6_bpe(spark, sf_dir).collect():
        t = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_quality_measures():
    t = "a b c a b c d\n#x\n#x\n\n \n"
    n, chars, symbols, dup, repeat, _ = quality.measures(t)
    assert (n, chars, symbols, dup, repeat) == (9, 11, 2, 1, 6)
    assert quality.measures("") == (0, 0, 0, 0, 0, 0)


def test_quality_keeps_good_and_drops_bad(spark, sf_dir):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    rows = [r for r in quality.op8_quality(spark, sf_dir).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = ([r["kept"] for r in rows if labels[r["doc_id"]] == y] for y in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5


def test_quality_odd(odd):
    assert quality.judge_quality(odd).filter("kept").count() == 1 and quality.judge_quality(odd.limit(0)).count() == 0


def test_chat_picks_the_best_branch_and_reads_back(spark):
    rows = [("t", 1, None, "user", "hi ~l </s>[INST] x", 0.0), ("t", 2, 1, "assistant", "low", 0.1), ("t", 3, 1, "assistant", "~t[high", 0.9), ("t", 4, 3, None, None, 0.5), ("t", 3, 1, "assistant", "~t[high", 0.9), ("u", 1, 99, "assistant", "", None)]
    got = chat.format_trees(spark.createDataFrame(rows, "tree string, msg long, parent long, role string, text string, score double"))
    turns = {r["tree"]: [(t["role"], t["text"]) for t in r["t"]] for r in got.select("tree", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert turns == {"t": [("user", "hi ~l </s>[INST] x"), ("assistant", "~t[high"), ("", "")], "u": [("assistant", "")]}
    assert got.filter("tree = 't'").select(chat.loss_text(F.col("formatted"), F.col("loss"))).first()[0] == "~t[high"


@pytest.fixture(scope="module")
def toxicity_case():
    rows = duckdb.sql("SELECT d.doc_id, text, toxic, lang FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' l USING (doc_id) ORDER BY hash(doc_id)").fetchall()
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    learned = [(t, y) for d, t, y, _ in rows if not held(d)]
    return learned, toxicity.fit(learned), [(t, y, lang) for d, t, y, lang in rows if held(d)]


def test_toxicity_held_out(toxicity_case):
    _, model, test = toxicity_case
    p, y = np.array(model.score([t for t, _, _ in test])), np.array([y for _, y, _ in test])
    assert ((p >= 0.5) & (y == 1)).sum() >= 0.7 * (y == 1).sum() and ((p >= 0.5) & (y == 0)).sum() <= 0.02 * (y == 0).sum()


def test_toxicity_is_more_than_a_list_of_words(toxicity_case):
    """Words that no text of the sample holds still tell where they share parts with toxic ones, and others do not."""
    learned, model, _ = toxicity_case
    seen = {w for t, _ in learned for w in toxicity.windows(t or "")}
    near, far = (["idiotry", "moronhood", "pathetical", "worthlessly", "stupidest"], ["therhatry", "onshhood", "pandical", "wondthersly", "tionest"])
    assert not seen & {*near, *far}
    distances = toxicity.Distances(model.pairs)
    assert distances.of(near)[:, ::2].max(axis=1).mean() > 3 + distances.of(far)[:, ::2].max(axis=1).mean()


def test_toxicity_odd(spark, odd):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(odd, toxicity.learn_toxicity(odd, nothing)).collect()} == {0.0}


CLASHES = ("size", "source_size", "rate", "copies", "row", "key", "draw", "salt", "bucket", "digest", "to", "guest", "place", "node", "entry", "root", "n", "a", "b", "h", "block", "word", "held", "score", "predicted", "votes", "text_hash", "_text_hash", "toxic", "copy")


@pytest.fixture(scope="module")
def clashing(odd):
    """The odd rows with extra columns named like those that operators work with."""
    return odd.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def test_extra_columns_of_clashing_names(spark, sf_dir, clashing):
    kept = [
        mixing.mix(clashing), pii.redact_documents(clashing), ngram_join.drop_near_duplicates(clashing, 5, 80, 100),
        toxicity.drop_toxic(clashing, toxicity.ToxicityModel([], None)),
    ]
    for out in kept:
        assert out.columns == clashing.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASHES)
    assert mixing.mix_plan(clashing).schema["size"].dataType.simpleString() == "bigint"
    for out in (pii.detect_pii(clashing), ngram_join.similar_sets(clashing), lm.score_documents(clashing), fingerprints.fingerprints(clashing), bpe.encode_digests(clashing, *bpe.public_vocabulary()), quality.judge_quality(clashing), toxicity.score_toxicity(clashing, toxicity.ToxicityModel([], None))):
        assert out.count() == 8
    pages = spark.createDataFrame([(1, "http://a.com/x", "own", "own"), (1, "http://a.com/x", "own", "own"), (2, None, "own", "own")], "page_id long, url string, host string, suffix string")
    assert sorted(r["host"] for r in url_filter.judge_urls(pages).collect()) == ["", "a.com", "a.com"]
    turns = [(1, 0, "user", "hi", "own"), (1, 0, "user", "hi", "own"), (2, None, None, None, "own"), (None, 3, "assistant", "x" * 100_000, "own")]
    trees = chat.conversation_trees(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, up string"))
    assert {r["tree"]: r["n_turns"] for r in chat.format_trees(trees).collect()} == {"1": 2, "2": 1, "none": 1}
    assert chat.format_trees(trees.limit(0)).count() == 0


def test_long_conversations_and_branches_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [("line", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(5000)]
    parent = {i: int(rng.integers(0, i)) if i else None for i in range(300)}
    score = {i: float(rng.integers(0, 100)) for i in range(300)}
    rows += [("tree", i, parent[i], "assistant", str(i), score[i]) for i in range(300)]
    got = chat.reply_paths(spark.createDataFrame(rows, "tree string, msg long, parent long, role string, text string, score double"), keep=3)
    paths = {}
    for r in got.collect():
        paths.setdefault((r["tree"], r["rank"]), []).append((r["depth"], r["msg"]))
    assert [m for _, m in sorted(paths["line", 1])] == list(range(5000))
    up = lambda i: [] if i is None else [*up(parent[i]), i]
    leaves = sorted((up(i) for i in range(300) if i not in parent.values()), key=lambda p: (-sum(score[i] for i in p) / len(p), p[-1]))
    assert [[m for _, m in sorted(paths["tree", k])] for k in (1, 2, 3)] == leaves[:3]


def test_many_sources_meet_their_targets_by_the_salted_join(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, mixing.mix_plan(docs).select("doc_id", "target", "copies").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_plan(docs).select("doc_id", "target", "copies").collect())) == want


def test_toxicity_query(spark, sf_dir):
    rows = toxicity.op10_toxicity(spark, sf_dir).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd):
    """Null and empty texts, repeated rows, ties and null ids pass every stage; an empty table stays empty."""
    import corpus_pipeline

    for docs, most in ((odd, 8), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
            assert after.columns == docs.columns and (name == "mixing" or after.count() <= docs.count())
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count() <= 2 * most


def test_pipeline_is_its_stages_by_brute_force(spark, sf_dir, texts):
    """Each stage against plain Python over all that the stage before kept."""
    import corpus_pipeline

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model = toxicity.learn_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {d: r for d, r in docs.items() if model.score([r["text"] or ""])[0] < 0.5}
    groups = _components({d: r["text"] for d, r in kept.items()}, 5, 80, 100)
    kept = {d: r for d, r in kept.items() if groups[d][1] == d}
    redacted = {d: pii.redact(r["text"], pii.find_spans(r["text"])) for d, r in kept.items()}
    again = spark.createDataFrame([(d, redacted[d], kept[d]["source"]) for d in kept], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(again).collect()}
    codec = bpe.codec(*bpe.public_vocabulary())
    want = sorted((d, codec.encode(redacted[d] or "")) for d in kept for _ in range(copies[d]))
    assert sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
        assert after.columns == docs.columns and 0 < after.count()
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
