import hashlib
import os
import random
import tempfile

import brute
import numpy as np
import pytest

import corpus_pipeline
from commitlens.llm import ann, html_extract, warc

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark):
    rng = random.Random(3)
    copy = rng.randbytes(800).hex()
    html = {1: copy, 2: copy, 9: copy, 3: "short", 4: "short", 5: None, 6: "", 7: "é\r\n\r\n" * 400, 8: rng.randbytes(9_000_000).hex(), 10: "\x1f\x8b\x08" * 500}
    df = spark.createDataFrame([(i, f"http://x/{i}\n", h) for i, h in html.items()], "page_id long, url string, html string")
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/warc"
    warc.write(df.repartition(3), path)
    for size in (8 << 20, 700):
        if size == 700:
            small = [os.path.join(path[7:], f) for f in os.listdir(path[7:]) if f.startswith("part")]
            if max(map(os.path.getsize, small)) > 4_000_000:
                size = 100_000
        got = {r["page_id"]: r for r in warc.read(spark, path, size).collect()}
        assert set(got) == set(html)
        for i, h in html.items():
            body = (h or "").encode()
            assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
            revisit = i in (1, 2)
            assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
            assert got[i]["payload"] is None if revisit else bytes(got[i]["payload"]) == body


def test_warc_files_are_plain_gzip(spark):
    import gzip

    df = spark.createDataFrame([(i, "u", "x" * (1000 + i)) for i in range(20)], "page_id long, url string, html string")
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/warc"
    warc.write(df, path)
    parts = [f for f in os.listdir(path[7:]) if f.startswith("part")]
    assert sum(gzip.open(os.path.join(path[7:], f)).read().count(b"WARC/1.1\r\n") for f in parts) == 20


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script><style>p{}</style></head><body class="nav">
<header><a href="/">Site</a></header><nav><ul><li><a href=1>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, really.</div>
<div id=main><h1>Title &amp; more</h1><p>First  paragraph, with <b>bold
text</b>. And more, of it.<br>Next line.<p>Second paragraph &lt;here&gt;; it is long enough, surely. Yes.</p>
<div class="ad-slot">Buy now, cheap!</div><ul><li>One item, listed.</li><li>Two.</ul><blockquote>Quoted words, said once.</blockquote></div>
<aside>Related, things.</aside><section id="comments"><p>Nice article, thanks. Really.</p></section><form>Name <input></form><footer>&copy; 2020, all.</footer></body></html>"""


@pytest.mark.parametrize("article", ["div", "article", "main"])
def test_main_text(article):
    page = PAGE.replace("<div id=main>", f"<{article} id=main>").replace("said once.</blockquote></div>", f"said once.</blockquote></{article}>")
    assert html_extract.main_text(page) == "Title & more\nFirst paragraph, with bold text. And more, of it. Next line.\nSecond paragraph <here>; it is long enough, surely. Yes.\nOne item, listed.\nTwo.\nQuoted words, said once."


def test_text_of_the_article_is_not_dropped_by_a_name():
    page = """<body><nav><a href=1>x</a></nav><{0}><h1>T</h1><p>Energy <math><mi>E</mi></math> is here, said one. More text here, surely.</p>
    <div class='related-work'><p>Others did things, too. See them there.</p></div><h2 id='search-results'>Search results</h2><p>We found many, of all kinds. Good.</p>
    <div class='related-stories'><a href=1>One more story</a></div><div class='related-reading'><a href=1>More</a></div></{0}><footer>f</footer></body>"""
    kept = "T\nEnergy E is here, said one. More text here, surely.\nOthers did things, too. See them there.\nSearch results\nWe found many, of all kinds. Good."
    assert html_extract.main_text(page.format("article")) == kept and html_extract.main_text(page.format("div")) == kept
    link = "<div><p>Some text here, said one. And more of it, too.</p><p><a href=x>A paragraph that is one long link, all of it.</a></p></div>"
    assert html_extract.main_text(link) == "Some text here, said one. And more of it, too.\nA paragraph that is one long link, all of it."


@pytest.mark.parametrize(("page", "text"), [
    ("<div>" * 100_000 + "hello, there. Good.", "hello, there. Good."),
    ("<span>" * 50_000 + "a, b." + "</b>" * 50_000 + "<p>x, y. z</p>" * 100, "a, b." + "\nx, y. z" * 100),
])
def test_deeply_nested_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("page", [None, "", "<html></html>", "<script>x</script>", "<", "<p", "<!-- open", "</p></div>", "<a href='x"])
def test_odd_pages(page):
    assert html_extract.main_text(page) == ("<" if page == "<" else "")  # a lone bracket is text


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>Hello, there. Good day.</p>"), (1, "u", None), (None, None, "plain text only")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()) == [(0, "plain text only", 15), (1, "", 0), (1, "Hello, there. Good day.", 23)]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.4
    x[100:400] = x[100]  # a third of a list is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        score = x @ x[q]
        assert all(abs(score[v] - s) < 1e-9 and v != q for _, v, s in found)
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(score, 9)))[:10]
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hits >= 0.9 * 10 * len(got)


def test_nearest_with_repeated_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist(), "x", 0.5) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, *rows[:60], *rows[:60], (7, x[9].tolist(), "x", 0.5)], "vec_id long, embedding array<double>, list string, score double").repartition(5)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[7] = max(score[7], score[9])
        assert [r for r, _, _ in found] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20
        assert all(abs(score[v] - s) < 1e-9 and v != q for _, v, s in found)
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id = 1"), 20).orderBy("rank").collect()] == [(1, 2), (1, 3)]
    assert ann.nearest(df.where("false"), df, 5).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        rows = {r["doc_id"]: r for r in out.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        if name == "near_duplicates":
            comp = brute.linked(list(before.items()), 5, 80, 100)
            assert set(rows) == {d for d in before if comp[d][1] == d}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            for d, _, hit, *_ in brute.contamination(list(before.items()), items):
                assert (rows[d]["text"] != before[d]) == (hit > 0)
        if name == "pii":
            assert all(not brute.base_pii(r["text"]) or len(brute.base_pii(before[d])) > 0 for d, r in rows.items())
            assert all(rows[d]["text"] == t for d, t in before.items() if not brute.base_pii(t))


def test_pipeline_drops_toxic(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean, toxic = [d for d, t in label.items() if t == 0], [d for d, t in label.items() if t == 1]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d in kept for d in toxic) <= 0.3 * len(toxic)
