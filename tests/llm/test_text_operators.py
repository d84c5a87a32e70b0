"""Operators over documents against brute force on the edge-case table."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from touchline.llm import bpe, minhash, mixing, quality_crf, quality_rules, repeats
from touchline.llm.components import components

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_is_tiktokens_and_comes_back(spark, docs, no_docs):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    encoded = bpe.encode(docs, PATH)
    got = sorted((np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in bpe.decode(encoded, PATH).collect())
    want = sorted((encoding.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert got == want
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0


def test_slices_are_the_patterns_on_random_text():
    rng = np.random.default_rng(3)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    parts = ["'", "'s", "'re", "ll", "s", "t", " ", "  ", "\n", "\t", " ", "　", "a", "É", "1", "٣", "½", "!", "#", "中", "́", "😀", "\x00", "\x85"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)] + ["'s" * 200, "a" * 3000, " " * 500 + "x"]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(b) for b in raw])).astype(np.int64)
    ids, ends = bpe.Encoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    bounds = np.append(0, ends)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == encoding.encode_ordinary(t), t


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_and_rules(spark, docs, no_docs):
    stats = quality_rules.with_stats(docs)
    assert set(docs.columns) <= set(stats.columns)
    for r in stats.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(r.text)
    assert quality_rules.with_stats(no_docs).count() == 0
    # texts whose symbols tell the label
    rows = [(i, " ".join(f"w{i}q{k}" + ("#" if i % 3 == 0 else "") for k in range(70))) for i in range(90)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(None, 1), (5, None)], "doc_id long, quality int")
    measured = quality_rules.with_stats(texts).cache()
    rules = quality_rules.learn(quality_rules.training_rows(measured, labels).cache())
    kept = {r.doc_id for r in measured.where(~quality_rules.base_failed() & quality_rules.verdict(rules)).collect()}
    assert kept == {i for i in range(90) if i % 3}
    assert quality_rules.learn(quality_rules.training_rows(measured, labels.where("false"))) == []
    assert measured.where(quality_rules.verdict([])).count() == 90


def brute_components(rows):
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates(spark, docs, no_docs, seed):
    rng = np.random.default_rng(seed)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for group in range(6):  # chains of edits, so that ends of a chain are linked through its middle only
        words = [f"g{group}w{k}" for k in range(int(rng.choice([6, 9, 40, 200])))]
        for k in range(7):
            rows.append((100 + group * 10 + int(rng.integers(0, 10)), " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[int(rng.integers(0, len(words)))] = f"e{k}{rng.integers(0, 99)}"
    seen, unique = set(), []
    for r in rows:
        if r[0] is None or r[0] not in seen or r[0] == 9:
            unique.append(r)
        seen.add(r[0])
    got = minhash.near_duplicates(spark.createDataFrame(unique, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(unique)
    assert minhash.near_duplicates(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    if seed:
        assert minhash.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_one_id_with_different_texts(spark):
    text = lambda n, *tail: " ".join([*(f"{n}w{k}" for k in range(60)), *tail])
    rows = [(5, text("a")), (5, text("b")), (6, text("a", "x")), (7, text("b", "x")), (8, text("c")), (9, text("c")), (9, text("d")), (10, text("d", "x")), (11, text("e"))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_components_of_a_long_path_and_loops(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (9, 3), (3, 9), (None, 4)], "u long, v long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {7: 7, 9: 3, 3: 3}


def brute_repeats(texts, length=200):
    often = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append((len(b), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~hit])))
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 2, 1])
def test_repeats(spark, docs, no_docs, monkeypatch, shard):
    monkeypatch.setattr(repeats, "SHARD", shard)
    rng = np.random.default_rng(shard)
    noise = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage = noise(230)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 9]
    rows += [(200 + k, noise(int(rng.integers(0, 150))) + passage[k % 20 : 230 - (k % 3) * 9] + noise(90)) for k in range(40)]
    rows += [(300, passage[:199]), (301, noise(150) + passage[:120] + noise(50))]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == brute_repeats([(t or "").encode() for _, t in rows])
    if shard == 4096:
        assert repeats.without_repeats(no_docs).count() == 0
        assert repeats.without_repeats(docs, carry=["lang", "key"]).columns == ["doc_id", "lang", "key", "n_bytes", "n_removed", "n_spans", "kept"]


def test_interval_tree_outputs_all_occurrences():
    left, right = b"L" * 168, b"R" * 200
    lefts = [left, left, b"x" + left[1:], left[:150] + b"y" * 18]
    rights = [right, right, right, right[:60] + b"z" * 140]
    groups = list(repeats.repeats_at_anchor(lefts, rights))
    assert any(sorted(g) == [0, 1, 2] or sorted(g) == [0, 1] for _, _, g in groups)
    reach = repeats.widest(lefts, rights)
    assert reach[0][:2] == [168, 168] and reach[1][:3] == [200, 200, 200]
    assert reach[0][3] == 150 and reach[1][3] == 60


def test_crf_scores(spark, docs, no_docs):
    good = [(i, "\n".join(f"plain words number {i} {k} go on here." for k in range(1 + i % 5)), 1) for i in range(80)]
    bad = [(100 + i, "\n".join(f"#{k} $$$ *** {i} %%% &&&" for k in range(1 + i % 5)), 0) for i in range(80)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    field = quality_crf.train(rows, rows.where("doc_id % 4 != 2"))
    scores = {r.doc_id: r.score for r in quality_crf.score(rows, field).collect()}
    assert min(scores[i] for i, _, _ in good) > 0.7 > 0.3 > max(scores[i] for i, _, _ in bad)
    edge = quality_crf.score(docs, field).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert quality_crf.score(no_docs, field).count() == 0
    blank = quality_crf.train(no_docs, rows.where("false"))
    assert {round(r.score, 9) for r in quality_crf.score(docs, blank).collect()} == {0.5}


def test_crf_slope_is_that_of_its_loss():
    rng = np.random.default_rng(2)
    counts, labels, weights = np.array([4, 1, 3]), np.array([1, 0, 0]), np.array([1.0, 0.5, 0.25])
    z, params = np.append(rng.normal(size=(8, 3)), np.ones((8, 1)), 1), rng.normal(size=8)
    _, slope = quality_crf.loss_and_slope(params, z, counts, labels, weights)
    for k, step in enumerate(np.eye(8) * 1e-6):
        above, below = (quality_crf.loss_and_slope(params + d, z, counts, labels, weights)[0] for d in (step, -step))
        assert abs((above - below) / 2e-6 - slope[k]) < 1e-6


def test_crf_reads_all_lines_of_a_sampled_document(spark, monkeypatch):
    """The lines that tell good from bad stand behind a thousand others that tell nothing."""
    told = {1: "plain words go on here.", 0: "#$ *** %%% &&&"}
    rows = [(i, "\n".join(["same line"] * 1000 + [told[i % 2]] * 600), i % 2) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    field = quality_crf.train(docs, docs)
    texts = spark.createDataFrame([(k, "\n".join([told[k]] * 9)) for k in told], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in quality_crf.score(texts, field).collect()}
    assert scores[1] > 0.7 > 0.3 > scores[0]
    monkeypatch.setattr(quality_crf, "CHAIN", 7)  # cut anywhere
    cut = {r.doc_id: r.score for r in quality_crf.score(texts, quality_crf.train(docs, docs)).collect()}
    assert cut[1] > 0.7 > 0.3 > cut[0]


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    counts = np.array([4, 1, 3])
    evidence, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    got, pairs, _ = quality_crf.marginals(evidence, counts, moves)
    at, expected = 0, np.zeros((2, 2))
    for n in counts:
        total, mass, edges = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(evidence[at + k] for k in range(n) if y[k]) + sum(moves[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            mass += w * np.array(y)
            for k in range(n - 1):
                edges[y[k], y[k + 1]] += w
        assert np.allclose(got[at : at + n], mass / total)
        expected += edges / total
        at += n
    assert np.allclose(pairs, expected)


def test_budgets_go_to_siblings_before_ancestors(spark):
    sizes = spark.createDataFrame([("a", "x", 10, 1), ("a", "y", 1000, 9), ("b", "x", 1000, 9), ("b", "y", 1000, 9)], "d string, s string, tokens long, docs long")
    got = {(r.d, r.s): r.budget for r in mixing.leaf_budgets(sizes, ["d", "s"], {"d": {"a": 1, "b": 1}}, F.lit(1000), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 490, ("b", "x"): 250, ("b", "y"): 250}  # y takes what x lacks
    sizes = sizes.where("NOT (d = 'a' AND s = 'y')")
    got = {(r.d, r.s): r.budget for r in mixing.leaf_budgets(sizes, ["d", "s"], {}, F.lit(1000), 1).collect()}
    assert got == {("a", "x"): 10, ("b", "x"): 495, ("b", "y"): 495}  # a is full, so its rest goes to b


def test_draws(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 3)  # many buckets per leaf
    rows = [(i, "en" if i % 2 else None, 1 + i % 7) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, n_tokens long").repartition(5)
    got = {r.doc_id: r.copies for r in mixing.draws(frame, ["lang"], {"lang": {"en": 3}}, F.expr("all_tokens * 7 DIV 10"), epochs=2, seed=4).collect()}
    total = sum(t for _, _, t in rows)
    leaves = defaultdict(list)
    for i, lang, t in rows:
        leaves[lang or ""].append((i, t))
    sizes = {k: sum(t for _, t in v) for k, v in leaves.items()}
    given = total * 7 // 10
    en = min(2 * sizes["en"], given * 3 // 4)
    budget = {"en": en, "": min(2 * sizes[""], given // 4)}
    want = {}
    for k, v in leaves.items():
        whole, rest = divmod(budget[k], sizes[k])
        upto = 0
        for _, i, t in sorted((hashlib.md5(f"4:{whole + 1}:{i}".encode()).hexdigest(), i, t) for i, t in v):
            upto += t
            if whole + (upto <= rest):
                want[i] = whole + (upto <= rest)
    assert got == want
    sized = docs.withColumn("n_tokens", mixing.word_count(F.col("text")))
    out = mixing.draws(sized, ["lang", "source"], {}, F.expr("all_tokens"), epochs=1)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert mixing.draws(no_docs.withColumn("n_tokens", F.lit(1)), ["lang"], {}, F.expr("all_tokens")).count() == 0
    assert {(r.text, r.n): None for r in docs.select("text", mixing.word_count(F.col("text")).alias("n")).collect()} == {(r.text, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))): None for r in docs.collect()}


def test_unequal_texts_without_ids_lose_nothing_to_each_other(spark):
    """Two texts whose 32-bit hashes agree, and a copy of the first: only the copies' bytes are repeated."""
    rows = spark.range(400_000).select(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512)).alias("text"))
    pair = rows.groupBy(F.hash(F.lit(True), "text").alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) = 2").orderBy("h").first().t
    docs = spark.createDataFrame([(None, pair[0]), (None, pair[1]), (None, pair[0])], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.kept) for r in repeats.without_repeats(docs).collect())
    assert got == [(256, 0, bytearray(pair[1].encode())), (256, 256, bytearray()), (256, 256, bytearray())]
