"""Archives, token files, neighbours and page wrappers, and the pipeline, on edge cases."""

import gzip
import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from touchline.llm import minhash, neighbours, simple8b, token_files, warc, wrappers
from touchline.llm.tables import fresh_folder, written

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- token files
def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 3000):
        for top in (1, 2, 300, 60_000, 2**32, 2**59):
            ids = (rng.random(n) * top).astype(np.uint64)
            if n > 3:
                ids[n // 2] = 2**64 - 1  # an escape
            words, entries, wide = simple8b.pack(ids)
            assert np.array_equal(simple8b.unpack(words, wide), ids)
            bounds = [*entries.tolist(), len(words)]
            for k in range(len(entries)):
                assert np.array_equal(simple8b.unpack(words[bounds[k] : bounds[k + 1]], wide), ids[k * simple8b.STRIDE : (k + 1) * simple8b.STRIDE])
    words, _, _ = simple8b.pack(np.ones(600, np.uint64))
    assert len(words) == 10


def test_token_files(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCKS_PER_FILE", 1)
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    folder = fresh_folder(spark, "test-ids")
    token_files.write(docs, folder, WORDS, end_id=2)
    read = token_files.read(spark, folder)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.with_starts(token_files.checksums(read)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = fresh_folder(spark, "test-ids")
    token_files.write(no_docs, empty, WORDS, end_id=2)
    assert token_files.with_starts(token_files.checksums(token_files.read(spark, empty))).count() == 0


# --- archives
def test_archives(spark):
    trap = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4
    rows = [(5, "http://a/", "x" * 120), (3, "http://b/\r\nEvil: 1", "x" * 120), (4, None, "short"), (6, "u", "short"), (7, "u", None), (8, "é", trap), (9, "u", "é中" * 60), (9, "u", "é中" * 60), (None, "u", "x" * 120), (10, "u", trap)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = fresh_folder(spark, "test-warc")
    warc.write(pages, folder)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.length, r.digest, bytes(r.payload)) for r in warc.read(spark, folder).collect()), key=str)
    want = []
    first = {"x" * 120: 3, trap: 8, "é中" * 60: 9}
    for i, _, body in rows:
        raw = (body or "").encode()
        again = i is not None and body in first and first[body] != i
        want.append((i, "revisit" if again else "response", first[body] if again else None, len(raw), hashlib.sha256(raw).hexdigest(), b"" if again else raw))
    assert got == sorted(want, key=str)
    none = fresh_folder(spark, "test-warc")
    warc.write(pages.where("false"), none)
    assert warc.read(spark, none).count() == 0


def test_chains_reject_marks_in_payloads_and_cut_files(spark, tmp_path):
    record = lambda body: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    inner = record(b"fake")
    data = record(b"one") + record(inner * 3) + record(b"two") + record(b"cut off")[:-9]
    offsets, _, successors = warc.candidates(data)
    assert len(offsets) == 7 and warc.reached(offsets, successors).sum() == 4
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(b"three")))
    (tmp_path / "c.warc").write_bytes(b"junk" + record(b"no"))
    got = sorted(bytes(r.payload) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == sorted([b"one", inner * 3, b"two", b"three"])


def test_every_gzip_member_is_read(spark, tmp_path):
    bodies = [b"one", b"two", b"three"]
    members = [gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n") for b in bodies]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    assert sorted(bytes(r.payload) for r in warc.read(spark, str(tmp_path)).collect()) == sorted(bodies)


# --- neighbours
def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_NODES", 150)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(600, 16)).astype(np.float32)
    points[50:90] = points[40]  # equal vectors
    rows = [(i, p.tolist(), "clash") for i, p in enumerate(points)]
    odd = [(1000, None, ""), (1001, [0.0] * 16, ""), (1002, [float("nan")] * 16, ""), (1003, [float("inf")] + [1.0] * 15, ""), (1004, [None] + [1.0] * 15, ""), (1005, [], ""), (None, [1.0] * 16, ""), (1100, [1.0, 2.0], ""), (7, points[7].tolist(), "clash")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, shard string").repartition(4)
    got = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"))
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((points.astype(float) - points[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        near = np.lexsort((np.arange(600), d))[:10].tolist()
        mine = sorted(by[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len(set(near) & {v for _, v, _ in mine})
    assert hits >= 0.95 * 300
    assert [v for _, v, _ in sorted(by[40])] == list(range(50, 60))
    assert set(by) == set(range(0, 600, 20))  # the lone vector of another dimension has no candidates
    assert neighbours.nearest(frame.where("false"), frame.where("false")).count() == 0
    few = frame.where("vec_id < 4")
    assert neighbours.nearest(few, few).groupBy("query_id").count().where("count <> 3").count() == 0


# --- pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p>a{{}}</style><script>if (a<b) document.write("<p>no</p>")</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<{tag}><h1>Head &amp; line</h1>{body}<div class="ad">Buy</div></{tag}><aside>Side</aside><form><input value="a>b">Name</form><div id="comments"><p>Nice!</p></div><footer>&copy; me</footer></body></html>"""


def page(tag, *paragraphs):
    return PAGE.format(tag=tag, body="".join(f"<p>{p}" for p in paragraphs))


def test_main_text(spark):
    rows = [
        (1, "http://h.org:80/a", page("article", "One <b>bold</b>\n  and&nbsp;more<br>line", "Two &lt;tag&gt; &#233;")),
        (2, "https://u:p@H.ORG/b", page("article", "Three")),
        (3, "http://d.org/", page('div class="post"', *[f"Long paragraph number {k} of the page" for k in range(5)])),
        (4, "http://d.org/2", page('div class="post"', "x")),
        (5, None, None), (6, "bad url", ""), (6, "bad url", ""), (None, "http://h.org/c", "<p>no holder</p> tail"), (8, "http://h.org/d", "<article><p>open <i>tags"),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in wrappers.extract(pages).collect()}
    want = {
        1: "Head & line\nOne bold and more line\nTwo <tag> é", 2: "Head & line\nThree", 3: "Head & line\n" + "\n".join(f"Long paragraph number {k} of the page" for k in range(5)), 4: "Head & line\nx",
        5: "", 6: "", None: "no holder\ntail", 8: "open tags",
    }
    assert got == {(i, u): (want[i], len(want[i])) for i, u, _ in rows}
    assert wrappers.extract(pages.where("false")).count() == 0
    one = {r.host: r for r in wrappers.infer(pages).collect()}
    assert "p#" in one["h.org"].wrapper and ")?" in one["h.org"].wrapper and ")+" in one["h.org"].wrapper


def test_custom_elements_and_closed_drawings_swallow_nothing():
    inner = ["<video-player src=a></video-player>", "<svg viewBox='0'/>", "<math/>", "<svg a=1><text>no</text></svg>", "<title-bar></title-bar>", "<video src=a>no</video>", "<button\n>no</button>"]
    for x in inner:
        assert [t for _, _, t, _ in wrappers.blocks(f"<article><p>one</p>{x}<p>two</p></article>")] == ["one", "two"], x


def read_by_wrapper(pages):
    items = []
    for p in pages:
        own = wrappers.shape(list(wrappers.blocks(p)))
        items = wrappers.aligned(items, own) if items else own
    matcher, slots = wrappers.Matcher(items), wrappers.Slots()
    for p in pages:
        slots.add(matcher, list(wrappers.blocks(p)))
    return [wrappers.article(p, json.dumps(items), json.dumps(slots.verdict())) for p in pages]


def alone(page):
    return read_by_wrapper([page])[0]


def test_names_of_frames_and_parts_of_tokens_hide_no_article():
    text = "<article class='post no-comments'><header class=entry-header><h1>T</h1></header><p>one</p></article>"
    for open_, close in [("<body class='single has-sidebar'>", ""), ("<div class='content with-sidebar'>", "</div>"), ("<main id=search-results>", "</main>"), ("<form>", "</form>"), ("<div class=widget>", "</div>")]:
        assert alone(f"{open_}{text}{close}") == "T\none", open_
    junk = "".join(f"<div class='{c}'>no</div>" for c in ("sidebar", "cookie-notice", "site-footer", "comment-list", "x ad"))
    assert alone(f"<main>{junk}<p>yes</p></main>") == "yes"
    assert alone(f"<div>{junk}<p>yes and more</p></div>") == "yes and more"


def test_slots_decide_what_is_article_text():
    page = "<body><article id=post-{0}><h1>Title {0}</h1><div>Read our terms</div>{1}<p>Share this story</p></article><div><p>unrelated</p></div></body>"
    pages = [page.format(k, "".join(f"<p>text {k} {i} with some more words</p>" for i in range(1 + k))) for k in range(4)]
    want = ["\n".join([f"Title {k}", *(f"text {k} {i} with some more words" for i in range(1 + k))]) for k in range(4)]
    got = read_by_wrapper(pages)
    assert not any("Read our terms" in t or "unrelated" in t for t in got)
    assert [t.replace("\nShare this story", "") for t in got] == want
    same = [f"<article><p>The very same article</p></article><div>{k}</div>" for k in range(5)]
    assert read_by_wrapper(same) == ["The very same article"] * 5  # copies of one page
    framed = [f"<div class=search><h1>Title {k}</h1><p>words {k}</p></div><div><p>a much longer text {k} beside it</p></div>" for k in range(3)]
    assert read_by_wrapper(framed) == [f"Title {k}\nwords {k}\na much longer text {k} beside it" for k in range(3)]


def test_places_in_a_wrapper():
    items = ["ul", ["+", ["li#"]], "/ul", ["?", ["h1#"]], ["+", ["p#"]], ["?", ["div", "p#", "/div"]]]
    m = wrappers.Matcher(items)
    assert m.names == ["ul", "li#", "/ul", "h1#", "p#", "div", "p#", "/div"]
    assert m.places(["ul", "li#", "li#", "/ul", "p#", "p#", "div", "p#", "/div"]) == [0, 1, 1, 2, 4, 4, 5, 6, 7]
    assert m.places(["ul", "new#", "li#", "/ul"]) == [0, -1, 1, 2]


def test_all_parts_of_an_article_without_holder_stay(spark):
    body = "<div class=post><h1>Title {0}</h1><div id=intro>intro {0}</div><div id=body><p>long body {0} with words</p></div><ul><li><a href=/x>Other {0}</a></ul></div>"
    pages = spark.createDataFrame([(k, "http://n.org/", body.format(k)) for k in range(4)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.extract(pages).collect()} == {k: f"Title {k}\nintro {k}\nlong body {k} with words" for k in range(4)}


def test_alignment_gives_optional_and_repeated_groups():
    a = wrappers.folded(["ul", "li#", "li#", "li#", "/ul", "h1#", "p#"])
    assert wrappers.to_text(a) == "ul (li#)+ /ul h1# p#"
    b = wrappers.folded(["ul", "li#", "/ul", "p#", "p#"])
    assert wrappers.to_text(wrappers.aligned(a, b)) == "ul (li#)+ /ul (h1#)? (p#)+"
    assert wrappers.aligned(a, a) == a


# --- pipeline
def test_pipeline_stages(spark, docs, tmp_path):
    texts = [(i, " ".join(f"t{i}n{k}" for k in range(120)), "en", f"src{i % 4}", 0) for i in range(40)]
    texts += [(100, texts[0][1], "en", "src1", 0), (101, texts[1][1] + " tail", "fr", "src2", 0), (102, "too short", "en", "src0", 0), (None, texts[2][1], None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(texts, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "repeated passages", "mixture", "token ids"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = written(stage(spark, rows, folder), "test-stage")
        seen.append(rows.collect())
        assert k == 4 or rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in seen[0]} == {*range(40), 100, 101, None}
    assert sorted(r.doc_id for r in seen[1]) == [*range(40)]  # the copy without an id goes, the one with an id stays
    cut = {r.doc_id: r for r in seen[2]}
    assert all(cut[i].text == texts[i][1] and cut[i].n_chars == len(texts[i][1]) for i in range(40))
    assert 20 <= len(seen[3]) <= 35
    assert {r.doc_id for r in seen[4]} == {r.doc_id for r in seen[3]}
    assert corpus_pipeline.run(spark, folder).count() == len(seen[4])


def test_one_row_of_each_near_duplicate_stays(spark, tmp_path):
    text = lambda n: " ".join(f"{n}w{k}" for k in range(60))
    rows = [(None, text("a")), (5, text("a")), (3, text("a") + " tail"), (7, text("b")), (7, text("b")), (None, text("c")), (None, text("c")), (8, text("d")), (8, text("e")), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = written(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)), "test-stage")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[k] for k in (2, 3, 5, 7, 8, 9, 10)], key=str)


def test_rows_without_an_id_are_drawn(spark, tmp_path):
    rows = [(None if k % 3 == 0 else k, " ".join(f"t{k}n{i}" for i in range(10)), "en", f"src{k % 3}") for k in range(90)]
    rows += [(1000, "one two " * 5, "en", "src1"), (1000, "one two " * 500, "en", "src2")]  # one id, two rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = written(corpus_pipeline.mixture(spark, docs, str(tmp_path)), "test-stage").collect()
    words = lambda x: sum(len(r[1].split()) for r in x)
    assert len({(r.doc_id, r.text) for r in got}) == len(got) and set(map(tuple, got)) <= set(rows)
    assert words(got) <= words(rows) * corpus_pipeline.MIX_PERCENT // 100
    assert sum(r.doc_id is None for r in got) >= 15


def test_minhash_keys_agree_for_equal_sets():
    own = np.sort(np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(minhash.bucket_keys(own), minhash.bucket_keys(own.copy())) and len(minhash.bucket_keys(own)) == minhash.BANDS
    assert len(minhash.bucket_keys(own[:1])) == 1 and len(minhash.bucket_keys(own[:0])) == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert {"op2_warc", "op5_mixing", "op12_prefix_trie"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op2_warc", "op5_mixing", "op12_prefix_trie"])
def test_sql_agrees(spark, name):
    import glob
    import os

    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = entry.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)
