"""Operator 11: main text of web pages by text-to-tag ratio.

The standard library's ``HTMLParser`` streams a page's events once; nothing builds a tree.

1. Lines: block-level tags and line breaks end a line.  A line has its text (white space runs
   become one space; character references are decoded), the tags met in it, the characters
   of it that are link text, and the innermost container it lies in.
2. Ratio: characters outside links over tags (at least 1).  Lines in parts that are no article by
   their tag, role, or a word of class or id (menus, page headers, footers, asides, notices, adverts,
   forms, reader comments) count as 0 and are never content.
3. Smoothing: the ratios are convolved with a Gaussian of ``SIGMA`` lines, so that a short line
   among long ones rises and a lone long one sinks.
4. Threshold clustering: lines whose smoothed ratio is at least ``LAMBDA`` standard deviations (the largest
   always) are content, the rest is not; runs of content lines are the regions.
5. Regions: the innermost container with at least ``HOLDS`` of the characters of all regions is the article.
   In an ``article`` or ``main`` element every line is kept, however short; in any other the lines from the first to the
   last region, unless more than half of a line is link text.

Scripts, styles, templates and hidden parts are no text.  If words of class or id rule out all text of a page,
they are left aside for that page.

Defined results: null or empty html, or none but ruled-out text, gives an empty text; unclosed and crossed
tags close with their container; plain text without tags is one line; repeated rows stay apart; extra
columns, whatever their names, are not looked at; an empty table gives an empty result.
A page is read as a whole, with memory in proportion to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices
from .registry import query

#: Lines of the Gaussian's standard deviation, and how many of them it reaches to each side.
SIGMA, REACH = 1.0, 2
#: Content lines have a smoothed ratio of at least so many standard deviations.
LAMBDA = 1.0
#: Share of the regions' characters that an article's container must hold.
HOLDS = 0.9

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text of the page.
NO_TEXT = frozenset("script style template noscript title svg math iframe object canvas audio video select datalist head".split())
#: Elements that are no article.
ASIDE = frozenset("nav footer aside form dialog menu button fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words of class or id that mark such parts.
ASIDE_WORDS = frozenset(("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation "
                         "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup "
                         "login share sharing social related recommended comment comments disqus reply replies respond widget pagination pager toolbar").split())
#: Elements whose own class does not count: it speaks of the page.
WHOLE = frozenset("html body article main".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul").split())
CONTAINERS = frozenset("article main section div body html td blockquote".split())
#: An element of the first kind is closed by the start of one of the second.
CLOSED_BY = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}),
             "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Line:
    __slots__ = ("link", "named", "path", "ruled", "tags", "text")

    def __init__(self, text: str, tags: int, link: int, path: tuple[int, ...], ruled: bool, named: bool):
        self.text, self.tags, self.link, self.path = text, tags, link, path
        self.ruled = ruled      # no article by tag or role
        self.named = named      # no article by a word of class or id


class Lines(HTMLParser):
    """Lines of a page, and the tag of each container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.containers: list[str] = []      # tag of each container by number
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # (tag, no text, ruled, named, container)
        self.path: tuple[int, ...] = ()
        self.parts: list[str] = []
        self.tags = self.link = 0
        self.mute = self.ruled = self.named = self.in_link = self.in_article = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            self.lines.append(Line(text, self.tags, min(self.link, len(text)), self.path, self.ruled > 0, self.named > 0))
            self.tags = 0
        self.parts, self.link = [], 0

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.parts.append(data)
            if self.in_link:
                self.link += len(" ".join(data.split()))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br" or tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        self.close_implied(tag)
        found = dict(attrs)
        role = (found.get("role") or "").strip().lower()
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search((found.get("style") or "").lower()) is not None
        mute = tag in NO_TEXT or hidden
        ruled = tag in ASIDE or role in ASIDE_ROLES or (tag == "header" and not self.in_article)
        words = _WORD.findall(f"{found.get('class') or ''} {found.get('id') or ''}".lower()) if tag not in WHOLE else ()
        named = any(w in ASIDE_WORDS for w in words)
        container = tag in CONTAINERS
        if container:
            self.path += (len(self.containers),)
            self.containers.append(tag)
        self.open.append((tag, mute, ruled, named, container))
        self.count(tag, mute, ruled, named, 1)

    def count(self, tag: str, mute: bool, ruled: bool, named: bool, by: int) -> None:
        self.mute += by * mute
        self.ruled += by * ruled
        self.named += by * named
        self.in_link += by * (tag == "a")
        self.in_article += by * (tag in ("article", "main"))

    def close_implied(self, tag: str) -> None:
        """Close what ``tag`` ends, if that is open inside the innermost container or table."""
        for k in range(len(self.open) - 1, -1, -1):
            at = self.open[k][0]
            if tag in CLOSED_BY.get(at, ()):
                while len(self.open) > k:
                    self.pop()
                return
            if at in CONTAINERS or at in ("table", "ul", "ol", "dl"):
                return

    def pop(self) -> None:
        tag, mute, ruled, named, container = self.open.pop()
        if container:
            self.end_line()
            self.path = self.path[:-1]
        self.count(tag, mute, ruled, named, -1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag not in VOID and any(t[0] == tag for t in self.open):
            while self.open[-1][0] != tag:
                self.pop()
            if tag in BLOCK:
                self.end_line()
            self.pop()

    def close(self) -> None:
        super().close()
        self.end_line()


def lines_of(html: str) -> Lines:
    parser = Lines()
    parser.feed(html)
    parser.close()
    return parser


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    """Convolution with a Gaussian that is cut off and sums to 1 (lines outside the page count as 0)."""
    at = np.arange(-reach, reach + 1)
    kernel = np.exp(-0.5 * (at / sigma) ** 2)
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[reach:reach + len(ratios)]


def content_lines(lines: list[Line], ruled: np.ndarray) -> np.ndarray:
    """Which lines belong to a region."""
    ratios = np.array([0.0 if r else max(len(x.text) - x.link, 0) / max(x.tags, 1) for x, r in zip(lines, ruled, strict=True)])
    level = np.where(ruled, 0.0, smoothed(ratios))
    threshold = min(LAMBDA * float(np.std(level)), float(level.max()))
    return ~ruled & (level >= threshold) & (level > 0)


def article_of(parser: Lines, found: np.ndarray) -> tuple[int, ...]:
    """Path of the innermost container that holds ``HOLDS`` of the regions' characters."""
    size = np.array([len(x.text) for x in parser.lines])
    goal = HOLDS * size[found].sum()
    held: dict[int, int] = {}
    paths: dict[int, tuple[int, ...]] = {}
    for k in np.flatnonzero(found):
        path = parser.lines[k].path
        for depth, c in enumerate(path):
            held[c] = held.get(c, 0) + int(size[k])
            paths.setdefault(c, path[:depth + 1])
    inner = [c for c, n in held.items() if n >= goal]
    return max((paths[c] for c in inner), key=len, default=())


def main_text(html: str | None) -> str:
    """The article of a page, its lines joined by one space."""
    parser = lines_of(html or "")
    lines = parser.lines
    ruled = np.array([x.ruled or x.named for x in lines], bool)
    if len(lines) and ruled.all():
        ruled = np.array([x.ruled for x in lines], bool)
    if not len(lines) or ruled.all():
        return ""
    found = content_lines(lines, ruled)
    if not found.any():  # nothing but link text
        return ""
    path = article_of(parser, found)
    inside = np.array([x.path[:len(path)] == path for x in lines], bool) & ~ruled
    if not any(parser.containers[c] in ("article", "main") for c in path):
        at = np.flatnonzero(found & inside)
        linked = np.array([2 * x.link > len(x.text) for x in lines], bool)
        span = np.zeros(len(lines), bool)
        span[at[0]:at[-1] + 1] = True
        inside &= span & ~linked
    return " ".join(x.text for x, k in zip(lines, inside, strict=True) if k)


def extract(df: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with ``text``, the main text of each page."""
    rows = df.select(*keep, F.col(html_column).cast("string").alias("__html"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in text_slices(b, "__html"):
                part = b.slice(at, to - at)
                texts = [main_text(h) for h in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
