"""Main text of web pages by tag-path ratios.

Each page is read into its text nodes, each with the path of tags from the root to it. Text length and punctuation are aggregated per
path and set in ratio to the path's number of nodes; the ratios are smoothed over the page in reading order, fused with the raw ones
and cut at a threshold taken from the page itself. The nodes that remain point to the smallest container that holds them all. Of its blocks
those stay that tags and roles do not name as menus, headers, footers, sidebars, notices, adverts, forms or reader comments. Classes and ids
are one feature beside the ratios: outside of an article element a name made of nothing but such words counts as a tag does; inside of one
such names as authors give to sections, too ("related", "discussion"), leave the block to its path's ratio. A name that only holds such a
word makes a block doubtful, which goes if it is mostly links and its path stays below the threshold. So does, outside an
article element, a block made of links.

One page is worked on at a time inside an Arrow batch; pages never meet, so there is no shuffle. Paths are numbers (of the parent's path and
the tag), and elements are walked once, so time and memory are linear in the page, also when it nests deeply.

Defined results: null and empty pages and pages without text give an empty text; repeated rows are judged alone; an empty table gives
no rows; unclosed and stray tags are closed as browsers do for paragraphs, list items and table cells, or at the end of their parent.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>?|</[^>]*>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:@][-\w:.@]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")

# Element names of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object canvas video audio select xmp noembed noframes annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption optgroup option".split()
)
CONTAINER = frozenset("article main section div body html td center table tbody tr".split())
ARTICLE_NAMES = frozenset("article main".split())
BOILERPLATE_TAGS = frozenset("head nav footer aside form button dialog fieldset menu label input".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar aside rail ad ads adv advert adverts advertisement advertising "
    "adsense adslot adbox sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "subscribe subscription newsletter signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies "
    "respond discussion form search widget toolbar pagination pager skip".split()
)
#: Those that authors give to parts of their articles, too: there, the path's ratio decides. A single paragraph may also be a "comment".
AUTHOR_NAMES = frozenset("discussion related recommended recommendations search notice notices alert form social share sharing promotion".split())
#: Words that say nothing about a part but its form or place.
NEUTRAL_NAMES = frozenset(
    "area articles bar block bottom box button buttons col column container content entries entry field fields global group header holder icon inner items item "
    "js layout left link links list local main module outer page panel post posts primary right row secondary section site slot small stories text title top "
    "unit wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the key is closed by the start of one of the values.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "option", "optgroup"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}),
}
#: The open elements that a start tag closes.
CLOSES = {tag: [e for e, by in CLOSED_BY.items() if tag in by] for tag in frozenset().union(*CLOSED_BY.values())}
#: Elements past which a start tag closes nothing.
SCOPE = frozenset("article main section div table ul ol dl body html nav aside header footer form blockquote td th".split())


class Element:
    __slots__ = ("boilerplate", "depth", "doubtful", "in_article", "link", "named", "parent", "path", "tag")

    def __init__(self, tag: str, attrs: str, parent: Element | None, paths: dict[tuple[int, str], int]):
        self.tag, self.parent = tag, parent
        names: set[str] = set()
        hidden, role, label, only, some, plain = False, "", tag, False, False, False
        if attrs and not attrs.isspace():
            for name, a, b, c in ATTRIBUTE.findall(attrs):
                name, value = name.lower(), a or b or c
                if name in ("class", "id"):
                    for token in value.split() if name == "class" or tag not in HEADINGS else ():  # a heading's id repeats its text
                        parts = {x.lower() for x in NAME_PART.findall(token)}
                        names |= parts
                        if not parts.isdisjoint(BOILERPLATE_NAMES):
                            rest = {x for x in parts - BOILERPLATE_NAMES - NEUTRAL_NAMES if not x.isdigit()}
                            only, some = only or not rest, some or bool(rest)
                            plain = plain or (not rest and not (parts & BOILERPLATE_NAMES) <= (AUTHOR_NAMES | {"comment"} if tag == "p" else AUTHOR_NAMES))
                    if name == "class" and value:
                        label = f"{tag}.{' '.join(sorted(value.split()))}"
                elif name == "role":
                    role = value.lower()
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    hidden = True
        self.path = paths.setdefault((parent.path if parent else -1, label), len(paths))
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or (parent.link if parent and tag not in BLOCK else False)
        self.in_article = (parent.in_article if parent else False) or tag in ARTICLE_NAMES or role in ("main", "article")
        whole = tag in ("html", "body") or tag in ARTICLE_NAMES  # their class names speak of the page's kind
        within = bool(parent and parent.in_article)
        decides = only and not whole and (not within or plain)
        self.boilerplate = (
            (parent.boilerplate if parent else False)
            or hidden
            or (tag in BOILERPLATE_TAGS and not (within and tag == "label"))
            or role in BOILERPLATE_ROLES
            or (tag == "header" and not within)
            or decides
            or (tag == "article" and not names.isdisjoint({"comment", "comments", "reply", "ad", "advert", "advertisement"}))
            or (not whole and {"site", "header"} <= names or {"page", "header"} <= names)
        )
        self.doubtful = (parent.doubtful if parent else False) or (not whole and some)
        self.named = (parent.named if parent else False) or (only and not whole and within)


def text_nodes(page: str) -> list[tuple[Element, str, int]]:
    """(element, raw text, block number) of all text nodes in page order; text between two block borders shares a number."""
    paths: dict[tuple[int, str], int] = {}
    root = Element("html", "", None, paths)
    top, nodes, block, at = root, [], 0, 0
    open_ = Counter({"html": 1})  # elements by tag between the root and the top
    # of these, by tag, those since the last element past which an end tag, or a start tag that closes others, does not reach
    near: dict[str, list[Counter]] = {"end": [Counter()], "start": [Counter()]}
    walls = {"end": SCOPE, "start": SCOPE - CLOSED_BY.keys()}

    def enter(e: Element) -> None:
        nonlocal top
        top = e
        open_[e.tag] += 1
        for kind, wall in walls.items():
            if e.tag in wall:
                near[kind].append(Counter())
            else:
                near[kind][-1][e.tag] += 1

    def leave(e: Element | None) -> None:
        """Closes elements down to ``e``."""
        nonlocal top
        while top is not e and top.parent is not None:
            open_[top.tag] -= 1
            for kind, wall in walls.items():
                if top.tag in wall:
                    near[kind].pop()
                else:
                    near[kind][-1][top.tag] -= 1
            top = top.parent

    find = TOKEN.search
    while True:
        m = find(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            nodes.append((top, text, block))
        if not m:
            return nodes
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            e = top if (open_ if tag in SCOPE else near["end"][-1])[tag] > 0 else None  # a stray end tag does not leave its container
            while e is not None and e.tag != tag:
                e = e.parent
            if e is not None and e.parent is not None:
                leave(e.parent)
            if tag in BLOCK:
                block += 1
            continue
        if tag == "html":
            continue
        if tag == "br":
            nodes.append((top, " ", block))
            continue
        if tag in BLOCK:
            block += 1
        if tag in VOID:
            continue
        e = top if any(near["start"][-1][x] > 0 for x in CLOSES.get(tag, ())) else None
        while e is not None:
            if tag in CLOSED_BY.get(e.tag, ()):
                leave(e.parent or root)
                break
            e = e.parent
        attrs = m["attrs"]
        if attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, at)
            at = end.end()
            continue
        enter(Element(tag, attrs, top, paths))


def path_scores(nodes: list[tuple[Element, str]]) -> np.ndarray:
    """The fused ratio of each text node: (characters + punctuation, per node of its path), raw times smoothed over the page."""
    totals: dict[int, list[float]] = {}
    for e, text in nodes:
        t = totals.setdefault(e.path, [0, 0, 0])
        t[0] += len(text)
        t[1] += len(PUNCTUATION.findall(text))
        t[2] += 1
    ratio = np.array([(t := totals[e.path])[0] / t[2] * (1 + t[1] / t[2]) for e, _ in nodes])
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
    smooth = np.convolve(np.pad(ratio, 2, mode="edge"), kernel / kernel.sum(), "valid")
    return np.sqrt(ratio * smooth)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    every = text_nodes(page)
    nodes = [(e, text, block) for e, text, block in every if not e.boilerplate]
    solid = [(e, s) for e, text, _ in nodes if (s := text.strip())]
    if not solid:
        return ""
    score = path_scores(solid)
    threshold = min(float(score.mean()), float(score.std()) or float(score.mean()))
    chosen = [e for (e, _), s in zip(solid, score.tolist(), strict=True) if s >= threshold]
    best: dict[int, float] = {}  # of each path
    for (e, _), s in zip(solid, score.tolist(), strict=True):
        best[e.path] = max(best.get(e.path, 0.0), s)
    # the smallest container that holds all chosen nodes; elements below it are walked once
    root, below = chosen[0], {id(chosen[0])}
    for e in chosen[1:]:
        walked = []
        while id(e) not in below and e is not root:
            walked.append(id(e))
            if e.depth > root.depth:
                e = e.parent
            else:
                below.add(id(root))
                root = root.parent
        below.update(walked)
    while root.parent is not None and root.tag not in CONTAINER:
        root = root.parent
    if root.in_article:
        while root.tag not in ARTICLE_NAMES and root.parent is not None and root.parent.in_article:
            root = root.parent

    known: dict[int, bool] = {id(root): True}

    def inside(e: Element) -> bool:
        walked = []
        while id(e) not in known and e.depth > root.depth:
            walked.append(id(e))
            e = e.parent
        ok = known.get(id(e), False)
        known.update((k, ok) for k in walked)
        return ok

    blocks: dict[int, list[str]] = {}
    linked: Counter = Counter()
    doubtful: set[int] = set()
    named: set[int] = set()
    strong: set[int] = set()
    for e, text, block in nodes:
        if not inside(e):
            continue
        text = html.unescape(text)
        blocks.setdefault(block, []).append(text)
        if e.link:
            linked[block] += len(text.strip())
        if e.doubtful:
            doubtful.add(block)
        if e.named:
            named.add(block)
        if best.get(e.path, 0.0) >= threshold and text.strip():
            strong.add(block)
    out = []
    for block, texts in blocks.items():
        line = " ".join("".join(texts).split())
        most = 0.5 if block in doubtful else 2 if root.in_article else 0.9
        if line and (block in strong or (block not in named and linked[block] < most * len(line))):
            out.append(line)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per input row: page_id, url, text, n_chars (code points of the text)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
