"""Main text of web pages by tag-path ratios.

A page becomes text blocks, each with its root-to-leaf path of block tags and their classes.

1. For every path the text outside links and the punctuation are aggregated to ratios a block; a heading takes
   the ratios of the block it introduces.
2. Both sequences of ratios are smoothed along the page and fused into one score a block, times the share of
   its path's text that is no link.
3. Markup feeds the score by factors of the path: elements that are no text of a page's own (menus, footers,
   forms) weigh nothing, those that only call themselves so little, and so do blocks outside an article or main
   part where there is one.
4. The region is the smallest element that holds almost all of the text, weighed by score, with the headings
   beside it; what lies outside it weighs little.
5. Blocks whose score is over a share of the mean score of the text are the main text.

Reading a page takes time in proportion to its length, whatever its markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import trimmed

#: Element names.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math select object canvas audio video".split())
TO_THE_END = frozenset("script style textarea".split())
FOREIGN = frozenset("head nav footer aside form button dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("html body head title caption legend summary tbody thead tfoot tr td th button".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table td th article section div body html main".split())
#: A class, id or role made of words of the first list, and perhaps of the second, names what is not main text.
ASIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending popular pagination pager comment comments commentlist reply replies respond disqus discussion toolbar widget widgets copyright search searchbox contentinfo complementary alert alertdialog dialog skip outbrain taboola paywall disclaimer".split())
LAYOUT_NAMES = frozenset("area article articles author bar block blog body bottom box btn button buttons card cards center col column component container content count desktop element entry feed field fields foot form global google grid group head header heading icon icons info inline inner item items label latest left li link links list main media message meta middle mobile module more narrow new news outer page panel post posts primary reader readers region right row secondary section site slot small stories story strip sub tag tags text third thread tile title top trail ul unit user users view views wide wrap wrapper zone".split())

MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[.,;:!?、。，…]")

#: Open elements between a list item or cell and the next that ends it.
REACH = 256
#: Factors of blocks that call themselves foreign, of blocks outside the article, and outside the region.
NAMED, OUTSIDE_ARTICLE, OUTSIDE_REGION = 0.01, 0.01, 0.01
#: Share of the scored text that the region holds, reach of the smoothing, share of the mean score that a block needs.
SHARE, SPREAD, CUT = 0.9, 2, 0.03


class Element:
    """An open element: its number, number of its path, factor, that of headings in it, and whether it lies in an article."""

    __slots__ = ("tag", "number", "path", "weight", "heading", "article", "parent")

    def __init__(self, tag: str, number: int, path: int, weight: float, heading: float, article: bool, parent: Element | None):
        self.tag, self.number, self.path, self.weight, self.heading, self.article, self.parent = tag, number, path, weight, heading, article, parent


class Page:
    """The blocks of a page in order, and its tree of elements as a list of parents (children follow parents)."""

    def __init__(self, html: str):
        self.parents, self.tags = [-1], [""]
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.owners: list[Element] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._open: dict[str, int] = {}
        self.at = self.root = Element("", 0, -1, 1.0, 1.0, False, None)
        self._pieces: list[str] = []
        self._links = self._linked = 0
        self._read(html)

    def _flush(self) -> None:
        if self._pieces:
            text = "".join(self._pieces)
            self._pieces.clear()
            if text := " ".join((unescape(text) if "&" in text else text).split()):
                self.texts.append(text)
                self.linked.append(self._linked)
                self.owners.append(self.at)
        self._linked = 0

    def _close_to(self, element: Element) -> None:
        self._flush()
        while self.at is not element:
            self._open[self.at.tag] -= 1
            self.at = self.at.parent

    def _up(self, tags: set[str] | frozenset[str], scopes: frozenset[str] = frozenset()) -> Element | None:
        """The nearest open element of some tags, none beyond a scope or, with scopes, REACH elements up; does not climb if none is open."""
        if not any(self._open.get(t) for t in tags):
            return None
        up, steps = self.at, 0
        while up is not self.root and up.tag not in tags:
            steps += 1
            if up.tag in scopes or scopes and steps > REACH:
                return None
            up = up.parent
        return None if up is self.root else up

    def _start(self, tag: str, attributes: str) -> None:
        self._flush()
        self._links = 0
        if tag in VOID:
            return
        if self.at.tag == "head" and tag != "title" or tag == "body":
            if up := self._up({"head"}):
                self._close_to(up.parent)
        if tag in CLOSES_P and self.at.tag == "p":
            self._close_to(self.at.parent)
        if tag in ENDS and (up := self._up(ENDS[tag], SCOPES - ENDS[tag])):
            if tag == "tr" and up.tag != "tr" and up.parent.tag == "tr":
                up = up.parent
            self._close_to(up.parent)
        in_article = tag == "header" and self.at.article  # of what heads an article, headings alone belong to it
        name, foreign, named = tag, tag in FOREIGN or tag == "header" and not in_article, False
        for m in ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "class":
                name += "." + value
            if kind in ("class", "id", "role"):
                words = ({w.lower() for w in PIECES.findall(x)} for x in value.split())
                named |= any(w & ASIDE_NAMES and w <= ASIDE_NAMES | LAYOUT_NAMES for w in words)
            elif kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and HIDDEN.search(value):
                foreign = True
        weight = 0.0 if foreign else NAMED if named and tag not in ("html", "body") else 1.0
        article = tag in ("article", "main") and weight == 1.0
        path = self._paths.setdefault((self.at.path, name), len(self._paths))
        whole = (self.at.heading if tag in HEADINGS else self.at.weight) * weight
        self.at = Element(tag, len(self.parents), path, whole * NAMED if in_article else whole, self.at.heading * weight, self.at.article or article, self.at)
        self.parents.append(self.at.parent.number)
        self.tags.append(tag)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _read(self, html: str) -> None:
        place, pattern, no_end = 0, TAG, set()
        while True:
            found = MARKUP.search(html, place)
            if text := html[place : found.start() if found else len(html)]:
                self._pieces.append(text)
                if self._links:
                    self._linked += len(text)
            if not found:
                break
            begin, kind = found.start(), found[0]
            if kind in ("<!--", "<![CDATA[", "<!", "<?"):
                close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(kind, ">")
                end = html.find(close, found.end() - 2 * (kind == "<!--"))
                if kind == "<![CDATA[":
                    self._pieces.append(html[found.end() : end if end >= 0 else len(html)])
                place = end + len(close) if end >= 0 else len(html)
                continue
            m = pattern.match(html, begin)
            if not m and pattern is TAG:  # a quote that nothing closes: from here on quotes mean nothing
                pattern = PLAIN_TAG
                m = pattern.match(html, begin)
            if not m:
                break  # a tag that nothing closes
            place, tag = m.end(), m[2].lower()
            if m[1]:
                if tag == "a":
                    self._links = max(self._links - 1, 0)
                elif tag in BLOCKS:
                    if up := self._up({tag}):
                        self._close_to(up.parent)
                        self._links = 0
                    elif tag in ("p", "div"):
                        self._flush()
            elif tag in RAW:
                if not m[3].endswith("/") and tag not in no_end:
                    end = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(html, place)
                    if end:
                        place = end.end()
                    elif tag in TO_THE_END:
                        break
                    else:
                        no_end.add(tag)
            elif tag in BLOCKS:
                self._start(tag, m[3])
            elif tag == "br":
                self._pieces.append(" ")
            elif tag == "a":
                self._links += 1
        self._flush()


def _smooth(values: np.ndarray) -> np.ndarray:
    span = np.arange(-SPREAD, SPREAD + 1)
    kernel = np.exp(-(span**2) / 2)
    return np.convolve(values, kernel)[SPREAD : SPREAD + len(values)] / np.convolve(np.ones(len(values)), kernel)[SPREAD : SPREAD + len(values)]


def path_ratios(page: Page) -> np.ndarray:
    """Fused and smoothed path ratios of text and punctuation, one a block."""
    length = np.array([len(t) for t in page.texts], float)
    linked = np.minimum(np.array(page.linked, float), length)
    marks = np.array([0 if k else len(MARKS.findall(t)) for t, k in zip(page.texts, page.linked, strict=True)], float)
    path = np.unique([x.path for x in page.owners], return_inverse=True)[1]
    total, own, points, blocks = (np.bincount(path, w) for w in (length, length - linked, marks, np.ones(len(path))))
    text_ratio, mark_ratio, free = (own / blocks)[path], (points / blocks)[path], (own / total)[path]
    ahead = -1
    for k in range(len(path) - 1, -1, -1):
        if page.owners[k].tag not in HEADINGS:
            ahead = k
        elif ahead > k:
            text_ratio[k], mark_ratio[k] = max(text_ratio[k], text_ratio[ahead]), max(mark_ratio[k], mark_ratio[ahead])
    return (1 + _smooth(np.log1p(text_ratio))) * (1 + _smooth(np.log1p(mark_ratio))) * free


def content(page: Page) -> np.ndarray:
    """Which blocks of a page are main text."""
    length = np.array([len(t) for t in page.texts], float)
    score = path_ratios(page) * np.array([x.weight for x in page.owners])
    inside = np.array([x.article for x in page.owners])
    if inside.any():
        score[~inside] *= OUTSIDE_ARTICLE
    owner = np.array([x.number for x in page.owners])
    held = np.bincount(owner, length * score, len(page.parents))
    for k in range(len(held) - 1, 0, -1):
        held[page.parents[k]] += held[k]
    region = max((k for k in range(len(held)) if held[k] >= SHARE * held[0]), default=0)
    while region and page.tags[region] not in ("article", "main", "section", "div", "td", "body"):
        region = page.parents[region]
    headed = {page.parents[x.number] for x in page.owners if x.tag in HEADINGS and x.weight}
    while page.parents[region] in headed and page.tags[page.parents[region]] not in ("", "html", "body"):
        region = page.parents[region]  # a heading beside the region heads its neighbours too
    up = region  # an article that holds the region is the region
    while up:
        if page.tags[up] in ("article", "main"):
            region = up
        up = page.parents[up]
    within = np.zeros(len(held), bool)
    within[region] = True
    for k in range(region + 1, len(held)):
        within[k] = within[page.parents[k]]
    home = region  # what leads to the region from below the body: its headings head the region too
    while page.parents[home] > 0 and page.tags[page.parents[home]] not in ("html", "body"):
        home = page.parents[home]
    leads = np.zeros(len(held), bool)
    leads[home] = True
    for k in range(home + 1, len(held)):
        leads[k] = leads[page.parents[k]]
    heads = np.array([x.tag in HEADINGS for x in page.owners]) & leads[owner]
    score[~within[owner] & ~heads] *= OUTSIDE_REGION
    mean = (score**2 * length).sum() / max((score * length).sum(), 1e-300)
    return (score >= CUT * mean) & (score > 0)


def extract(html: str | None) -> str:
    """Main text of a page: blocks joined by an empty line; '' for null, empty and textless pages."""
    page = Page(html or "")
    if not page.texts:
        return ""
    return "\n\n".join(t for t, ok in zip(page.texts, content(page), strict=True) if ok)


@trimmed
def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html), n_chars in code points.

    Null, empty and textless pages have the text ''. Null ids and urls stay null; rows that repeat each other give
    a row each; other columns are ignored; an empty table gives an empty result. Pages are read whole, each on
    its own, in time and memory in proportion to its length, however deep or broken its markup.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(_run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
