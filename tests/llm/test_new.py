"""Sharding, the prefix trie and collocations against brute force, with the odd cases; cases mended in older operators."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, collocations, lm, mixing, ngram_join, pii, prefix_trie, quality, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "x", 1) for i, t, lang in rows], DOCS)


def _rows(n, seed=1):
    rng = random.Random(seed)
    out = [(i, "copy" if rng.random() < 0.35 else f"text {i} " + "w" * rng.randrange(40), "en") for i in range(n)]
    return [*out, (None, None, None), (None, None, None), (3, "copy", "en"), (3, "copy", "en"), (n + 5, "", None), (n + 6, "y" * 50_000, "de")]


def _brute_shards(rows, shards, nodes, law):
    """Row by row: (shard, slot) by row number, rows in order of turn."""
    ring = sorted((int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(nodes))
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda i: (int(digest(rows[i][1])[16:31], 16), rows[i][0] is not None, rows[i][0] or 0))
    weight = [1 if law == "rows" else len((r[1] or "").encode()) + 1 for r in rows]
    most = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)] if law == "rows" else [-(-sum(weight) // shards)] * shards
    load, count, out = [0] * shards, [0] * shards, []
    for i in order:
        place = int(digest(rows[i][1])[:15], 16)
        at = next((k for k, (p, _) in enumerate(ring) if p >= place), 0)
        shard = next(s for _, s in ring[at:] + ring[:at] if load[s] < most[s])
        out.append((rows[i][0], rows[i][1], shard, count[shard]))
        load[shard] += weight[i]
        count[shard] += 1
    return out, load


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding_equals_one_row_at_a_time(spark, monkeypatch, law):
    monkeypatch.setattr(sharding, "BINS", 4)
    monkeypatch.setattr(sharding, "WALKED", 8)
    rows = _rows(150)
    got = sharding.shard_documents(_docs(spark, rows), law, 5, 8)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    want, load = _brute_shards(rows, 5, 8, law)
    assert sorted(((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got.collect()), key=str) == sorted(want, key=str)
    if law == "rows":
        assert max(load) - min(load) <= 1


def test_sharding_keeps_copies_together_and_moves_little(spark):
    rows = [(i, f"t{i // 3}", "en") for i in range(600)]
    placed = {k: {r["doc_id"]: (r["text"], r["shard"]) for r in sharding.shard_documents(_docs(spark, rows), "rows", k).collect()} for k in (8, 9)}
    groups = defaultdict(set)
    for text, shard in placed[8].values():
        groups[text].add(shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 8
    assert sum(placed[8][i] != placed[9][i] for i in placed[8]) < 0.5 * len(rows)  # dealt by hash modulo shards, 8 of 9 would move


def test_sharding_odd_sizes(spark, tmp_path):
    assert sharding.shard_documents(_docs(spark, [])).count() == 0
    few = sharding.shard_documents(_docs(spark, [(1, "a", "en"), (2, None, "en")])).collect()
    assert len({r["shard"] for r in few}) == 2 and {r["slot"] for r in few} == {0}
    with pytest.raises(ValueError, match="rows or bytes"):
        sharding.shard_documents(_docs(spark, []), "key")
    docs = sharding.shard_documents(_docs(spark, _rows(40)), shards=4)
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards")).select(docs.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))


def _brute_trie(sequences):
    """(conv, depth, parent, n, children, leaves, saved, sha) from {conv: [(role, text)]}."""
    nodes = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        own = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += not kids[k]
    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(sequences[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, d int, rep string"


def _trie_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def _conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-5, 200), 70):
        length = rng.choice([1, 2, 3, 5, 8, 13])
        rows += [(c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], rng.choice(["a b", "c", "", None]) if rng.random() < 0.4 else f"say {t}", 0, "") for t in range(length)]
    return [*rows, (None, 1, "user", "lost", 0, ""), *[(500 + k, t, "user", f"deep {t} x", 0, "") for k in range(3) for t in range(40 + 10 * k)], (700, 3, "user", "twice", 0, ""), (700, 3, "user", "twice", 0, "")]


def _sequences(rows):
    held = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(s)] for c, s in held.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = _conversations(seed)
    assert _trie_rows(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == _brute_trie(_sequences(rows))


def test_trie_of_rebuilt_conversations(spark):
    rows = _conversations(3)
    own = _sequences(rows)
    rebuilt = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = own.get(head, [])[:h] + s[h:]
    turns, convs, _ = prefix_trie.rebuilt(spark.createDataFrame(rows, TURNS))
    assert _trie_rows(prefix_trie.prefix_trie(turns, convs)) == _brute_trie(rebuilt)
    assert any(not s for s in rebuilt.values())  # some conversations have no turn left


def test_trie_odd(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    long = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("a b").alias("text"))
    copies = spark.range(3000).select((F.col("id") + 10).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("a b").alias("text"))
    trie = prefix_trie.conversation_trie(long.unionByName(copies))
    assert trie.count() == 5001
    top = trie.filter("depth = 1").first()
    assert (top["n_convs"], top["n_leaves"], top["saved_tokens"]) == (3001, 1, 6000)
    assert top["ends_sha256"] == hashlib.sha256(",".join(map(str, range(10, 3010))).encode()).hexdigest()


def _brute_collocations(rows, most, least, covered, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, out = defaultdict(Counter), []
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, most + 1):
                for i in range(len(ws) - k + 1):
                    f[lang or "und"][tuple(ws[i : i + k])] += 1
    for lang, c in f.items():
        n = sum(a for p, a in c.items() if len(p) == 1)
        phrases = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in phrases.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in phrases.items():
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if not 100 * inside[p] >= covered * a:
                scored.append((-score, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, ph.decode(), a, left, right, n, -s) for i, (s, _, ph, a, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("most", "least", "top"), [(3, 3, 25), (4, 2, 2000), (2, 2, 2000)])
def test_collocations_equal_brute_force(spark, most, least, top):
    rng = random.Random(4)
    rows = [(" ".join(rng.choice(["The", "of", "ÜBER", "naïve", "a", "b", "c.", "d,", "\n", "x\ty", "e\x0bf", "new york city"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("the of a " * 400, "en"), ("z" * 3000 + " q. " + "z" * 3000 + " q", "de"), (" . , ", "fr")] * 2
    df = spark.createDataFrame([(t, lang, 0, "") for t, lang in rows], "text string, lang string, rank int, phrase string")
    got = collocations.collocations(df, most, least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute_collocations(rows, most, least, 50, top)


def test_collocations_odd(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    none = spark.createDataFrame([(None, None), (" . ", "en"), ("once only words", "en")], "text string, lang string")
    assert collocations.collocations(none).count() == 0


def test_pointers_grow_and_merge():
    columns = np.array([[1, 1, 1, 2, 1], [5, 5, 6, 5, 5], [7, 0, 7, 7, 7]], dtype=np.uint64)
    found = collocations._frequent(columns, np.array([2, 1, 9, 3, 1]), 3)
    assert sorted((tuple(int(x) for x in p), f) for p, f in found) == [((1, 5), 4), ((1, 5, 7), 3), ((1, 6), 9), ((1, 6, 7), 9), ((2, 5), 3), ((2, 5, 7), 3)]
    wide = [np.array([2, 2, 0]), np.array([1, 1, 0]), np.array([3, 3, 4])]
    rows, n = collocations._distinct(wide, 1 << 30)
    assert [list(r) for r in rows] == [[0, 2], [0, 1], [4, 3]] and n.tolist() == [1, 2]


def test_pii_takes_digits_of_any_length():
    assert isinstance(pii.find_spans("x 300.1.2.3." + "0" * 5000 + "1.5 y"), list)
    assert pii._bounded("0" * 5000 + "12") == 12 and pii._bounded("9" * 5000) == 10**6


def _thue_morse(k):
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_are_told_apart(spark):
    a, b = _thue_morse(10)
    assert ngram_join.word_hashes(a) != ngram_join.word_hashes(b)
    assert ngram_join.word_hashes("X" * 70) == ngram_join.word_hashes("x" * 70)
    rows = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_sets(rows, 4, 85, 100).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_tokens_of_many_texts_are_those_of_each():
    texts = ["a B c", "", None, "  ", "Foo bar\nbaz", "x" * 2000 + " y", "é È"] * 30
    flat, lengths = lm.tokens_of(texts)
    assert (flat == np.concatenate([lm.tokens(t) for t in texts])).all() and lengths.tolist() == [len(lm.tokens(t)) for t in texts]


def test_kept_normalisers_change_no_score(monkeypatch):
    rng = np.random.default_rng(1)
    share = np.log(rng.dirichlet(np.ones(20)))
    contexts, words = rng.integers(0, 21 * 21, 500), rng.integers(0, 20, 500)
    kept = lm.LogBilinear(share)
    twice = np.concatenate([kept.log_scores(contexts[:300], words[:300]), kept.log_scores(contexts[300:], words[300:])])
    monkeypatch.setattr(lm, "KEPT_CONTEXTS", 0)
    assert np.allclose(twice, lm.LogBilinear(share).log_scores(contexts, words), atol=1e-5)
    every = lm.LogBilinear(share).log_scores(np.full(20, 7), np.arange(20))
    assert abs(np.exp(every).sum() - 1) < 1e-5


def test_rows_without_id_draw_by_text(spark):
    rows = [(None, f"{i} a b c", None, "s", 1) for i in range(400)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), (1,), 1.25)
    assert 1900 < plan.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] < 2100  # 2000 are due


def test_trees_survive_messages_without_a_key(spark):
    rows = [("t", 1, None, "user", "hi", 1.0), ("t", None, 1, "user", "lost", 9.0), (None, 1, None, "user", "lost", 1.0), ("t", 2, 1, "assistant", "yes", 1.0), ("u", 5, 4, "user", "no parent", None)]
    out = chat.format_trees(spark.createDataFrame(rows, "tree string, msg int, parent int, role string, text string, score double"))
    assert {(r["tree"], r["leaf"], r["n_turns"]) for r in out.collect()} == {("t", 2, 2), ("u", 5, 1)}


def test_toxicity_is_fitted_in_one_task(spark):
    docs = spark.createDataFrame([(i, f"{'vile rot' if i % 2 else 'fine day'} {i} " * 30) for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.learn_toxicity(docs, labels)
    assert model.trees is not None
    assert toxicity.learn_toxicity(docs, labels.limit(0)).trees is None


@pytest.mark.parametrize("bad", [0.1, 0.5, 0.85])
def test_quality_judges_a_corpus_of_any_share_of_bad_texts(spark, bad):
    rng = random.Random(3)
    good = lambda: "\n".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(12)) + "." for _ in range(10))
    junk = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) + rng.choice(["###", "$$$", "%%%"]) for _ in range(120))
    rows = [(i, junk() if i < 200 * bad else good()) for i in range(200)]
    kept = {r["doc_id"] for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).filter("kept").collect()}
    assert kept == {i for i, _ in rows if i >= 200 * bad}


def test_quality_shape_votes():
    assert quality.shape_votes("Plain words, here.\nAnd (more) of them!") == [1, 1]
    assert quality.shape_votes("a# b$ c%\nx1 y% z3#") == [0, 0]
    assert quality.shape_votes("") == [0, quality.ABSTAIN] and quality.shape_votes("no end") == [1, quality.ABSTAIN]


def _plain_score(model, text):
    """The score by compressing every window anew, with no store of lengths."""
    rows = []
    for w in toxicity.windows(text):
        row = []
        for marked, plain in model.pairs:
            size = lambda side, x: len(toxicity._compressor(side)(toxicity.HEAD + x + toxicity.TAIL))
            residue = size(marked, f" {w} ".encode()) - size(marked, b" ")
            row += [size(plain, f" {w} ".encode()) - size(marked, f" {w} ".encode()) if residue <= toxicity.MOST_RESIDUE else 0, residue]
        rows.append(row)
    if not rows:
        return model.trees.score(np.zeros((1, 1 + len(model.pairs) * (1 + 2 * len(toxicity.THRESHOLDS)))))[0]
    counts = [sum(r[k] >= d and r[k + 1] <= e for r in rows) for k in range(0, len(rows[0]), 2) for d, e in toxicity.THRESHOLDS]
    most = [max(r[k] for r in rows) for k in range(0, len(rows[0]), 2)]
    return model.trees.score(np.array([[len(rows), *counts, *(c / len(rows) for c in counts), *most]], float))[0]


def test_toxicity_scores_equal_compressing_every_window(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn_toxicity(docs, labels)
    assert model.trees is not None
    some = [(r["doc_id"], r["text"]) for r in docs.orderBy(F.length("text")).limit(25).collect()] + [(-1, None), (-2, ""), (-3, " . # "), (-4, "x" * 5000)]
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_toxicity(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    for i, text in some:
        want = _plain_score(model, text or "")
        assert abs(got[i][0] - want) < 1e-12 and got[i][1] == int(want >= 0.5)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 0)
    assert list(toxicity._fitted([]))  # a model without rows


def test_bpe_runs_are_batches_of_their_own(spark, monkeypatch):
    from lectern.llm import bpe

    path, pattern = bpe.public_vocabulary()
    docs = spark.createDataFrame([(i, f"Straße {i} über Ünïcode-words" * 9) for i in range(30)] + [(98, None), (99, "")], "doc_id long, text string")
    whole = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(docs, path, pattern).collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in bpe.encode_ids(docs, path, pattern).collect()} == whole and whole[98] == whole[99] == []
    assert [len(r) for r in bpe.in_runs(["x" * 300_000] * 5)] == [2, 2, 1]
    c = bpe.codec(path, pattern)
    widest, many = [], c.merge_many
    monkeypatch.setattr(c, "merge_many", lambda pieces: widest.append(len(pieces) * max(map(len, pieces))) or many(pieces))
    c._learn({f"q{i:x}zq" * 9 for i in range(9000)})
    assert len(widest) > 1 and max(widest) <= bpe.MERGED_BYTES


def test_url_model_takes_all_labelled_urls(spark):
    from lectern.llm import url_filter

    hosts, paths = ("a.net", "b.net", "c.com", "example.com"), ("es", "fr", "en", "de")
    urls = [(i, f"https://{hosts[i % 4]}/{paths[i // 4 % 4]}/{i:x}?q={i % 97}") for i in range(16_000)]
    labelled = sum(h.endswith(".com") or p in ("es", "fr") for h in hosts for p in paths) * 1000
    model = url_filter.learn_urls(spark.createDataFrame(urls, "page_id long, url string").repartition(4))
    assert abs(model.judged - labelled / 8) < 150 and model.accuracy > 0.95 and len(model.trees.leaves) == 50
