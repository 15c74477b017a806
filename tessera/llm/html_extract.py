"""Main-text extraction from HTML by text-to-tag ratios.

A page is read as a stream of standard-library parser events. Events become
lines (one per block of running text) that know their text, the tags they
hold and the region they stand in. Text in regions that the markup itself names
as something else than the article (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) is no running text: such lines are left out. A
line's ratio is its text by its tags. Ratios are smoothed with a Gaussian over
the lines of the page, and a threshold at half the standard deviation divides
the lines into clusters of content and of the rest.

The clusters select the content regions: the smallest region that holds nearly
all text of content lines, with the lines inside that the clusters leave open
(a short paragraph between or beside long ones has a low ratio, yet the article
loses nothing). Outside it come out regions that are mostly content by the ratio
of their own lines, single lines that reach the threshold themselves, and the
title and headings that lead to any of these. No tag makes a region win.

What the markup names is taken at its word with two exceptions. A <form> holding
most of the page's text outside links is a wrapper of the page, and so is an
element that only its class or id marks, if the page's title or article is in it. An element that is never closed, by its own end
tag or by the end of an element around it other than <body> and <html>, marks
nothing.

Defined results: null or empty html gives an empty text, and so does a page
without text; markup that the parser cannot read ends the page there; <br> is
white space; rows repeated in the table are extracted each; further columns are
ignored. Work grows with the length of the page, however deep tags are nested.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace
from .kernels import batches

SIGMA = 1.0
#: Share of a region's text that content lines hold where it comes out whole beside
#: the article, and of the page's text that makes a form or a marked element a wrapper.
BULK = 0.5
#: Share of the content lines' text that the article's region has to hold.
NEARLY = 0.9
# The elements of HTML by kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = _HEADINGS | {"p", "pre", "blockquote", "li"}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Elements without text of the page, and those that are no article by their name.
_SILENT = frozenset("script style noscript template head title iframe object audio video canvas svg".split())
_OTHER = frozenset("nav menu footer aside form button select textarea option datalist dialog".split())
# Roles and words of class and id that name the same things.
_ROLES = frozenset("navigation menu menubar banner contentinfo complementary search form alert alertdialog dialog".split())
_WORDS = frozenset("menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar notice notices cookie cookies consent ad ads advert adverts advertisement advertisements sponsored promo comment comments".split())
_ARTICLE_WORDS = frozenset("article entry post section".split())
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
_SECTION = re.compile(r"<!\[\s*(?:temp|cdata|ignore|include|rcdata|if|else|endif)\b", re.I)
_CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "option": frozenset(("option", "optgroup")),
}
_LISTS = frozenset(("ul", "ol", "dl", "table", "menu"))


_NONE, _NAMED, _MARKED, _COMMENTS = range(4)


def _kind(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> int:
    """What the markup says of an element: nothing, another thing than the article
    by its name, the same by its class or id only, or reader comments."""
    if tag in _SILENT or tag in _OTHER or tag == "header" and not inside_article:
        return _MARKED if tag == "form" else _NAMED
    found = _NONE
    for name, value in attrs:
        if value and name == "role" and value.lower() in _ROLES:
            return _NAMED
        if value and name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            words = set(_SPLIT.split(value.lower())) & (_WORDS | _ARTICLE_WORDS)
            if words & {"comment", "comments"}:
                return _COMMENTS
            if words & _WORDS and not (words <= _ARTICLE_WORDS | {"header"} and words & _ARTICLE_WORDS):
                found = _MARKED
    return found


class _Lines(HTMLParser):
    """Turns parser events into lines (region, text, tags, text outside links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[int, str, int, int]] = []
        self.parents: list[int] = [-1]
        self.names: list[str] = [""]
        self.says: list[int] = [_NONE]
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, region, silent
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self) -> None:
        if self.text:
            joined = _SPACE.sub(" ", "".join(self.text)).strip()
            if joined:
                self.lines.append((self.stack[-1][1], joined, self.tags, max(0, len(joined) - self.linked)))
                self.tags = 0
            self.text.clear()
        self.linked = 0

    def parse_html_declaration(self, i):
        # Only these marked sections are known to the parser; others are comments up to the next ">".
        if self.rawdata.startswith("<![", i) and not _SECTION.match(self.rawdata, i):
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1
        return super().parse_html_declaration(i)

    def _leave_head(self):
        """</head> may be omitted: the body, or content that cannot stand in a head, ends it."""
        k = len(self.stack) - 1
        while self.open.get("head") and k:
            if self.stack[k][0] == "head":
                self.flush()
                self._close(k)
            k -= 1

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "body" or tag not in _HEAD and self.stack[-1][0] == "head":
            self._leave_head()
        if tag in _INLINE:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "a":
                self.links += 1
            if tag not in _VOID and attrs:
                says = _kind(tag, attrs, False)
                if says:
                    self.flush()
                    self._open(tag, says)
            return
        self.flush()
        self.links = 0
        if tag in _VOID:
            return
        closed = [t for t, by in _CLOSED_BY.items() if tag in by and self.open.get(t)]
        if closed:
            for k in range(len(self.stack) - 1, 0, -1):
                top = self.stack[k][0]
                if top in closed:
                    self._close(k)
                    break
                if top in _LISTS or top not in _CLOSED_BY and top not in _INLINE:
                    break
        self._open(tag, _kind(tag, attrs, bool(self.open.get("article") or self.open.get("main"))))

    def _open(self, tag, says):
        self.parents.append(self.stack[-1][1])
        self.names.append(tag)
        self.says.append(says)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append((tag, len(self.parents) - 1, self.stack[-1][2] or tag in _SILENT))

    def _close(self, k):
        for tag, _, _ in self.stack[k:]:
            self.open[tag] -= 1
        del self.stack[k:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _INLINE:
            if tag == "a":
                self.links = max(0, self.links - 1)
            if self.stack[-1][0] == tag:
                self.flush()
                self._close(len(self.stack) - 1)
            return
        self.flush()
        self.links = 0
        if tag in ("body", "html"):
            self._end()
        if self.open.get(tag):
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self._close(k)

    def _end(self):
        """The body or the page ends: elements open there were never closed."""
        for tag, region, silent in self.stack:
            if not silent and tag not in _CLOSED_BY:
                self.says[region] = _NONE

    def handle_data(self, data):
        if self.stack[-1][0] == "head" and data.strip():
            self._leave_head()
        if not self.stack[-1][2]:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(values, reach, mode="edge"), kernel, mode="valid")


def _sums(parents: list[int], at, values) -> list[float]:
    """Sums of lines' values over every region with all that it holds, in one pass:
    a region's number is larger than that of the one around it."""
    out = [0.0] * len(parents)
    for r, v in zip(at, values):
        out[r] += v
    for r in range(len(parents) - 1, 0, -1):
        out[parents[r]] += out[r]
    return out


def _inside(parents: list[int], chosen) -> list[bool]:
    """For every region, whether it or one around it is chosen."""
    out = [bool(x) for x in chosen]
    for r in range(1, len(parents)):
        out[r] = out[r] or out[parents[r]]
    return out


def _running(parser: _Lines) -> list[tuple[int, str, int, int]]:
    """The lines that the markup does not name as something else than the article."""
    parents, says = parser.parents, parser.says
    sure = _inside(parents, [x in (_NAMED, _COMMENTS) for x in says])
    free = [0 if sure[x[0]] else x[3] for x in parser.lines]
    weight = _sums(parents, [x[0] for x in parser.lines], free)
    holds = _sums(parents, range(len(parents)), [x in ("h1", "article", "main", "form") for x in parser.names])
    wraps = [weight[r] >= BULK * max(1.0, weight[0]) and holds[r] > 0 for r in range(len(parents))]
    gone = _inside(parents, [x in (_NAMED, _COMMENTS) or x == _MARKED and not wraps[r] for r, x in enumerate(says)])
    return [x for x in parser.lines if not gone[x[0]]]


def content_blocks(html: str | None, *, sigma: float = SIGMA, bulk: float = BULK) -> list[str]:
    """The blocks of a page's main text, in page order."""
    if not html:
        return []
    parser = _Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # the parser's own word for markup that it cannot read
        pass
    parser.flush()
    parser._end()
    lines, parents, names = _running(parser), parser.parents, parser.names
    if not lines:
        return []
    at = [x[0] for x in lines]
    size = np.array([len(x[1]) for x in lines], float)
    ratio = size / np.maximum(1.0, np.array([x[2] for x in lines], float))
    smooth = _smooth(ratio, sigma)
    least = 0.5 * smooth.std()
    marked = smooth >= min(smooth.max(), least)
    weight = _sums(parents, at, size * marked)
    best = max(r for r in range(len(parents)) if weight[r] >= NEARLY * weight[0] and names[r] not in _BLOCKS)
    # Text outside counts by its own ratio, not by that of the lines around it.
    own = marked & (ratio >= least)
    around = {-1}
    r = best
    while r >= 0:
        around.add(r)
        r = parents[r]
    all_of, own_of = _sums(parents, at, size), _sums(parents, at, size * own)
    inside = _inside(parents, [r == best or r not in around and own_of[r] > bulk * all_of[r] for r in range(len(parents))])
    taken = np.array([inside[r] for r in at]) | own
    # Headings of what comes out; the page's title with the text between.
    heads = [names[r] in _HEADINGS for r in at]
    for k in range(len(lines) - 2, -1, -1):
        taken[k] |= heads[k] and taken[k + 1]
    first = int(np.argmax(taken))
    title = max((k for k in range(first) if names[at[k]] == "h1"), default=first)
    for k in range(title, first):
        taken[k] |= names[at[k]] in _BLOCKS - {"li"}
    return [x[1] for x, good in zip(lines, taken) if good]


def _run(stream):
    for batch in batches(stream):
        texts = ["\n".join(content_blocks(h)) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    workspace.ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
