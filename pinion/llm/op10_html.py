"""HTML extraction by tag-path ratios.

A page is parsed once into blocks of text, each with its root-to-leaf tag path. Per path the text length and the punctuation
per node are summed up, smoothed along the page and fused; paths above a threshold of their deviation hold content. The
heaviest of them is the core: the smallest element that holds nearly all its text, or the article around it, bounds the
content. Within, blocks of chosen paths stay, and what articles are made of beside them (headings, list items, cells, short
paragraphs); blocks of other paths go, as do lists of links. Class names only add to that: an element that is named for
something beside the article goes if it holds less than half of the page's text, and for words of two meanings only if its
paths are not chosen either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinion.llm.common import small, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = set("script style title textarea xmp iframe noembed noframes".split())
#: Elements that are never part of the text.
GONE = RAW | set("head nav footer aside button select option noscript template svg math object audio video canvas dialog menu datalist label input".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What an opening tag closes, if it is open above the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
CONTAINERS = set("html body div section article main ul ol dl table td th blockquote header footer nav aside form".split())
KEEPS_OPEN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ROOTS = {"html", "body", "article", "main"}
#: Leaves that an article has beside its paragraphs; elements whose names are part of a path.
STRUCTURE = HEADINGS | set("p li dt dd td th caption figcaption blockquote pre address summary".split())
GROUPS = set("ul ol dl table thead tbody tfoot tr figure".split())
LABELLED = set("div section ul ol table span".split())
#: Words of a class, id or role that name something beside the article, and words that may as well name a part of it.
BESIDE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social comment comments disqus respond reply replies pagination pager skip copyright complementary contentinfo".split()
)
UNSURE = set("masthead banner notice notices disclaimer alert related recommended discussion toolbar widget widgets search form".split())
NOT_WORDS = re.compile(r"[^a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
#: Of the deviation of the fused ratios; of the core's text that the root holds; links' share of a path's text; the share of a
#: page's text from which an element's name says nothing.
DEVIATIONS, ROOT_SHARE, LINKED, MOST = 0.6, 0.9, 0.6, 0.5


def names(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is hidden, and what it is named as: "beside", "unsure" or nothing."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, ""
    hidden, named = False, ""
    for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = (name or bare).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        if name in ("class", "id", "role") and tag not in ROOTS:
            for one in value.split():
                w = NOT_WORDS.split(one)
                if w[0] not in ("has", "with", "no", "without"):
                    if not BESIDE.isdisjoint(w):
                        named = "beside"
                    elif not named and not UNSURE.isdisjoint(w):
                        named = "unsure"
    return hidden, named


class Page:
    """Elements and blocks of a page. Unclosed tags are closed as browsers do for paragraphs, list items and table cells.

    Elements are numbered in page order; an element's blocks are first[e] up to last[e]. Paths are numbered by what they hold,
    so that a page is read in time linear in its length, however deep it is nested.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.path, self.gone, self.named, self.article = ["html"], [-1], [0], [False], [""], [-1]
        self.first, self.last = [0], [0]
        self.at: list[int] = []  # per block its element
        self.parts: list[list[str]] = []
        self.links: list[int] = []
        self.leaf: list[str] = ["html"]  # per path its last tag
        self._paths: dict[tuple[int, str], int] = {}
        self._read(html)
        self.text = [" ".join("".join(p).split()) for p in self.parts]

    def _element(self, tag: str, attributes: str, parent: int) -> int:
        hidden, named = names(tag, attributes)
        inside = self.article[parent]
        label = tag
        if tag in LABELLED and (m := re.search(r"class\s*=\s*[\"']?([^\"'>]*)", attributes)):
            label += "." + re.sub(r"\d+", "0", m[1])
        key = (self.path[parent], label)
        if key not in self._paths:
            self._paths[key] = len(self.leaf)
            self.leaf.append(tag)
        gone = self.gone[parent] or hidden or tag in GONE or tag == "header"
        if tag in HEADINGS and self.tag[parent] == "header" and inside >= 0 and not self.gone[self.parent[parent]] and not hidden:
            gone = False  # an article's own heading
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self._paths[key])
        self.gone.append(gone)
        self.named.append("beside" if tag == "form" else named)
        self.article.append(len(self.tag) - 1 if tag in ("article", "main") else inside)
        self.first.append(len(self.at))
        self.last.append(-1)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # tag, element
        places: dict[str, list[int]] = {"html": [0]}  # per tag its places in the stack
        solid = [0]  # places of elements that are not inline
        fresh, links = True, 0  # whether the next text begins a block; open links

        def text(raw: str) -> None:
            nonlocal fresh
            if fresh:
                if not raw.strip():
                    return
                self.at.append(stack[-1][1])
                self.parts.append([])
                self.links.append(0)
                fresh = False
            raw = unescape(raw) if "&" in raw else raw
            self.parts[-1].append(raw)
            if links:
                self.links[-1] += len(raw)

        def close(to: int) -> None:
            nonlocal links, fresh
            while len(stack) > to:
                tag, e = stack.pop()
                places[tag].pop()
                links -= tag == "a"
                if solid[-1] == len(stack):
                    solid.pop()
                if not stack or stack[-1][1] != e:
                    fresh = True
                    self.last[e] = len(self.at)

        top = lambda tags: max((p[-1] for t in tags if (p := places.get(t))), default=-1)
        at = 0
        while m := TOKEN.search(html, at):
            if m.start() > at:
                text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                i = top((tag,))
                if i > 0 and (tag not in INLINE or i > solid[-1]):
                    close(i)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                fresh = True
                continue
            if tag == "br":
                if not fresh:
                    self.parts[-1].append(" ")
                continue
            if tag in VOID:
                fresh |= tag == "hr"
                continue
            if tag == "html":
                continue
            inline = tag in INLINE
            if not inline:
                shut = CLOSES.get(tag, set())
                stop = max(top(CONTAINERS - shut), top(KEEPS_OPEN.get(tag, ())))
                while (i := top({*shut, "p"})) > max(stop, 0):
                    close(i)
            parent = stack[-1][1]
            e = parent
            if not inline or m[3] and (any(names(tag, m[3])) and not self.gone[parent]):
                e = self._element(tag, m[3], parent)
                fresh = True
            if not inline:
                solid.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, e))
            links += tag == "a"
        text(html[at:])
        close(0)


def fused_ratios(page: Page, blocks: list[int]) -> dict[int, tuple[float, int, int]]:
    """Per path of some blocks: the smoothed, fused ratio of text and punctuation per node; text; text in links."""
    stats: dict[int, list[int]] = {}
    for b in blocks:
        s = stats.setdefault(page.path[page.at[b]], [0, 0, 0, 0])
        s[0] += len(page.text[b])
        s[1] += len(PUNCTUATION.findall(page.text[b]))
        s[2] += 1
        s[3] += min(page.links[b], len(page.text[b]))
    rows = list(stats.values())
    smooth = lambda v: [(v[max(i - 1, 0)] + 6 * v[i] + v[min(i + 1, len(v) - 1)]) / 8 for i in range(len(v))]
    text, marks = smooth([s[0] / s[2] for s in rows]), smooth([s[1] / s[2] for s in rows])
    return {p: (t * (1 + k) * (s[0] - s[3] + 1) / (s[0] + 40), s[0], s[3]) for p, t, k, s in zip(stats, text, marks, rows, strict=True)}


def select(page: Page, blocks: list[int]) -> list[int]:
    """The blocks of the main text, of those that may hold it: of articles, if the page has any that are not next to nothing."""
    article = [b for b in blocks if page.article[page.at[b]] >= 0]
    if 10 * sum(len(page.text[b]) for b in article) >= sum(len(page.text[b]) for b in blocks):
        blocks = article
    ratio = fused_ratios(page, blocks)
    least = DEVIATIONS * pstdev([r for r, _, _ in ratio.values()])
    chosen = {p for p, (r, size, links) in ratio.items() if r >= least and links <= LINKED * size}
    core = max(chosen or ratio, key=lambda p: ratio[p][0] * ratio[p][1])
    # the smallest element that holds nearly all text of the core
    held = [0, *accumulate(len(page.text[b]) if page.path[page.at[b]] == core else 0 for b in range(len(page.at)))]
    of = {b for b in blocks if page.path[page.at[b]] == core}
    total = sum(len(page.text[b]) for b in of)
    root = max((e for e in range(len(page.tag)) if held[page.last[e]] - held[page.first[e]] >= ROOT_SHARE * total), default=0)
    while root and page.tag[root] in STRUCTURE:
        root = page.parent[root]
    if page.article[root] >= 0:
        root = page.article[root]
    within = page.article[root] >= 0
    begin, end = min(of), max(of)

    def stays(b: int) -> bool:
        path = page.path[page.at[b]]
        r, size, links = ratio[path]
        tag = page.leaf[path]
        if path == core:
            return True
        if links > LINKED * size and tag not in HEADINGS and tag != "p":
            return within and begin < b < end  # a list of links in the midst of an article is a part of it
        if path in chosen or tag in HEADINGS:
            return True
        e = page.parent[page.at[b]]
        while page.tag[e] in STRUCTURE or page.tag[e] in GROUPS:
            e = page.parent[e]
        # a short paragraph belongs to what stands beside it: content, or nothing but itself
        return tag in STRUCTURE and (held[page.last[e]] > held[page.first[e]] or within and page.tag[e] == "section")

    inside = [b for b in blocks if page.first[root] <= b < page.last[root] and stays(b)]
    title = [b for b in blocks if b < page.first[root]][-1:]  # a heading right before the root is its own
    if title and page.tag[page.at[title[0]]] in ("h1", "h2") and not any(page.tag[page.at[b]] == "h1" for b in inside):
        inside = title + inside
    return inside


def extract(html: str | None) -> str:
    """The main text: blocks joined by one newline; empty for null, empty and textless pages."""
    page = Page(html) if html else None
    if page is None or not page.at:
        return ""
    size = [0, *accumulate(0 if page.gone[page.at[b]] else max(0, len(t) - page.links[b]) for b, t in enumerate(page.text))]
    out, unsure = list(page.gone), [False] * len(page.tag)
    for e in range(1, len(page.tag)):
        up = page.parent[e]
        minor = size[page.last[e]] - size[page.first[e]] < MOST * size[-1]
        out[e] = out[e] or out[up] and not page.gone[up] or page.named[e] == "beside" and minor
        unsure[e] = unsure[up] or page.named[e] == "unsure" and minor
    blocks = [b for b, t in enumerate(page.text) if t and not out[page.at[b]]]
    sure = [b for b in blocks if not unsure[page.at[b]]]
    if sure and len(sure) < len(blocks):  # words of two meanings: only a path that others of the page hold too stays
        paths = {page.path[page.at[b]] for b in sure}
        ratio = fused_ratios(page, blocks)
        least = DEVIATIONS * pstdev([r for r, _, _ in ratio.values()])
        blocks = [b for b in blocks if not unsure[page.at[b]] or page.article[page.at[b]] >= 0 and (ratio[page.path[page.at[b]]][0] >= least or page.path[page.at[b]] in paths)]
    if not blocks:  # prose in an element that is none of the text by its tag is better than none
        never = {"nav", "footer", "head"} | RAW
        blocks = [b for b, t in enumerate(page.text) if len(t) >= 80 and len(PUNCTUATION.findall(t)) > 1 and page.links[b] <= LINKED * len(t) and page.tag[page.at[b]] not in never]
    return "\n".join([page.text[b] for b in select(page, blocks)]) if blocks else ""


def html_extraction(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (code points).

    Null and empty pages and pages without text have an empty text. Whole pages are read, in time linear in their length, however
    long or deeply nested. Rows are independent, so repeated rows have the same result; where paths tie, the first in the page
    is the core. An empty table gives an empty result. Other columns stay; clashing ones are replaced.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [extract(h) for h in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return pages.select(*rest, html_col).mapInArrow(run, pages.select(*rest).schema.add("text", "string").add("n_chars", "long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
