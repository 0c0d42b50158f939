"""Main text of pages: names inside of articles, a plain second version, pages that nest badly."""

import re
import time
from html.parser import HTMLParser

import pytest

from commitlens.llm import html_extract
from commitlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SENTENCE = "This is a full sentence, with commas, of the article. And it has another one; both stay where they are."
NAMED = ['<section id="discussion">%s</section>', '<section id="related">%s</section>', '<section class="search">%s</section>', '<div class="notice">%s</div>', '<p class="comment">%s</p>', '<div class="form">%s</div>', '<div class="social">%s</div>', "<label>%s</label>"]


@pytest.mark.parametrize("part", NAMED)
def test_named_parts_of_an_article_stay(part):
    page = f"<html><body><nav><a href=x>Home</a></nav><article><p>{SENTENCE}</p><p>{SENTENCE} More.</p>{part % (SENTENCE + ' Probe.')}</article></body></html>"
    assert html_extract.main_text(page) == "\n".join([SENTENCE, SENTENCE + " More.", SENTENCE + " Probe."])


def test_named_parts_without_prose_go():
    lists = "<ul class='related'><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div class='comments'><p>Reader one says, well, that it is so. And more.</p></div>"
    assert html_extract.main_text(f"<article><p>{SENTENCE}</p>{lists}</article>") == SENTENCE


@pytest.mark.parametrize("make", [lambda n: "<b><div>" + "<i>" * n + "</b>" * n, lambda n: "<p><table>" + "<i>" * n + "<div></div>" * n, lambda n: "<ul>" + "<li><em>x" * n, lambda n: "<div>" * n + "x" + "</div>" * n])
def test_bad_nests_take_linear_time(make):
    began = time.time()
    html_extract.main_text(make(40_000))
    assert time.time() - began < 20


class Plain(HTMLParser):
    """Blocks of text outside of what tags, roles or whole class names call boilerplate; no ratios, another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.raw = [], [[]], 0

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.BLOCK:
            self.blocks.append([])
        if tag in html_extract.VOID:
            self.blocks[-1] += [" "] * (tag == "br")
            return
        while self.open and self.open[-1][0] in html_extract.CLOSED_BY and tag in html_extract.CLOSED_BY[self.open[-1][0]]:
            self.open.pop()
        a = {k: v or "" for k, v in attrs}
        parts = [{x.lower() for x in html_extract.NAME_PART.findall(t)} for t in f"{a.get('class', '')} {a.get('id', '')}".split()]
        named = any(p & html_extract.BOILERPLATE_NAMES and all(x.isdigit() for x in p - html_extract.BOILERPLATE_NAMES - html_extract.NEUTRAL_NAMES) for p in parts)
        inside = any(t in html_extract.ARTICLE_NAMES for t, _ in self.open)
        bad = tag in html_extract.BOILERPLATE_TAGS | html_extract.RAW or a.get("role") in html_extract.BOILERPLATE_ROLES or (tag == "header" and not inside) or "hidden" in a or re.search("display: *none", a.get("style", "")) or (named and tag not in ("html", "body", "article", "main"))
        self.open.append((tag, bool(bad)))

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK:
            self.blocks.append([])
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(bad for _, bad in self.open):
            self.blocks[-1].append(data)


def test_words_against_a_plain_version(spark):
    """Over all pages of the smallest tables: the words of both agree for nearly all of the text."""
    got = {r["page_id"]: r for r in QUERIES["op7_html_extraction"](spark, SF).collect()}
    both = total = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        plain = Plain()
        plain.feed(r["html"] or "")
        want = set(" ".join("".join(b) for b in plain.blocks).split())
        mine = got[r["page_id"]]
        assert mine["n_chars"] == len(mine["text"]) and "<script" not in mine["text"]
        words = set(mine["text"].split())
        both, total = both + len(words & want), total + len(words | want)
    assert both >= 0.9 * total, both / total
