"""Operator 5: the main text of web pages, from parser events and text-to-tag ratios.

The standard library's parser streams events. Blocks of text are the lines of a page; each has the number
of its characters and of the tags in and around it. The ratios are smoothed with a Gaussian, clustered
around a threshold, and the lines above it select the content region: an article or main element that holds
most of their text, else the innermost container that holds all of it. All lines of that region are returned,
short ones too; what sits in menus, headers, footers, side bars, notices, adverts, forms, scripts, styles or
reader comments never counts. Where only a class or id name says so, the ratios may overrule it (``overruled``).

Time is linear in the page: containers and named elements are trees by parent, open elements are found by tag, and what
an element holds is summed up from its children.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sensorloom.llm.common import arrow_rows

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head script style noscript template nav header footer aside form button select textarea iframe svg canvas "
    "object menu dialog title audio video map datalist option".split())
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 "
    "h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CONTAINERS = frozenset("article body center div html main section table td".split())
#: Words of class and id names, and roles, of what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promotion banner cookie "
    "cookies consent gdpr notice notices alert sidebar side rail menu menus nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer comment comments commentlist reply replies respond disqus share sharing social "
    "related recommended newsletter subscribe subscription signup popup modal overlay login search pagination pager "
    "widget toolbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAME = re.compile(r"[a-z]+")
#: A start tag of these ends an open element of the same family.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
_WALLS = CONTAINERS | SKIPPED


class Blocks(HTMLParser):
    """Collects text blocks outside skipped elements: text, tags, innermost container, innermost element named away.

    Containers and named elements are numbered from 1 as they open; ``parent`` and ``outer`` give what is around them, 0 for
    nothing.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []
        self.places: dict[str, list[int]] = {}  # of the open elements by tag
        self.walls: list[int] = []  # places of the open elements that a stray tag does not close
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.kind, self.marked = [0], [""], [False]
        self.outer, self.plain = [0], [False]
        self.parts: list[str] = []
        self.tags = 0

    def skipping(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def container(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def named(self) -> int:
        return self.stack[-1][3] if self.stack else 0

    def last(self, tags) -> int:
        """The place of the innermost open element of some tags, -1 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close_from(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in _WALLS:
                self.walls.pop()

    def end_head(self, tag: str) -> None:
        """The end tag of a head may be left out: the body or anything else that is not of a head ends it."""
        if self.stack and (self.stack[-1][0] == "head" and tag not in IN_HEAD or tag == "body"):
            if self.places.get("head"):
                self.close_from(self.places["head"][0])

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.container(), self.named()))
            self.tags = 0
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        self.end_head(tag)
        if tag in BLOCKS and not self.skipping():
            self.end_block()
        if tag in VOID:
            return
        if tag in _CLOSES:
            at = self.last(_CLOSES[tag])
            if at >= max(self.last(("ul", "ol", "dl")), self.walls[-1] if self.walls else 0, 0):
                self.close_from(at)
        plain = self._named(tag, attrs)
        skip = self.skipping() or tag in SKIPPED or self._put_away(tag, attrs)
        if (skip or plain is not None) and not self.skipping():
            self.end_block()
        node, named = self.container(), self.named()
        if plain is not None and not skip:
            self.outer.append(named)
            self.plain.append(plain)
            named = len(self.outer) - 1
        if tag in CONTAINERS and not skip:
            self.parent.append(node)
            self.kind.append(tag)
            self.marked.append(self.marked[node] or tag in ("article", "main"))
            node = len(self.parent) - 1
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _WALLS:
            self.walls.append(len(self.stack))
        self.stack.append((tag, skip, node, named))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    @staticmethod
    def _named(tag, attrs) -> bool | None:
        """Whether a class or id is of ``NAMES`` words only; None if it has none of them."""
        if tag in ("html", "body", "article", "main"):
            return None
        words = [_NAME.findall(v) for key, value in attrs if value and key in ("class", "id") for v in value.lower().split()]
        words = [x for x in words if any(w in NAMES for w in x)]
        return any(all(w in NAMES for w in x) for x in words) if words else None

    @staticmethod
    def _put_away(tag, attrs) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        for key, value in attrs:
            if value and key == "role" and value.lower().strip() in ROLES:
                return True
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
        return False

    def handle_endtag(self, tag):
        self.tags += 1
        at = self.last((tag,))
        if tag in BLOCKS and not self.skipping():
            self.end_block()
        if at < 0:
            return
        # a stray end tag inside a container or a skipped part does not close what is around it
        if tag not in _WALLS and self.walls and self.walls[-1] > at:
            return
        if not self.skipping() and (tag in CONTAINERS or self.named() != (self.stack[at - 1][3] if at else 0)):
            self.end_block()
        if self.stack[at][1] and not (at and self.stack[at - 1][1]):
            self.tags = 0  # those of a skipped part are not around the next line
        self.close_from(at)

    def handle_data(self, data):
        if data.strip():
            self.end_head("")
        if not self.skipping():
            self.parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with the weights renormalised at the edges."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def clustered(values: np.ndarray) -> np.ndarray:
    """Which values are of the upper of two clusters: the threshold moves to the middle of both means."""
    line = values.mean()
    for _ in range(50):
        high = values >= line
        moved = (values[high].mean() + values[~high].mean()) / 2 if (~high).any() and high.any() else line
        if abs(moved - line) < 1e-9:
            break
        line = moved
    return values >= line


def selected(lines: list[tuple], sigma: float) -> np.ndarray:
    """The size of each line of content, 0 for the others.

    That is the upper cluster of the smoothed ratios and all with half of its mean, as two clusters part like lines too.
    """
    sizes = np.array([len(x[0]) for x in lines], dtype=float)
    ratios = sizes / np.array([max(1, x[1]) for x in lines])
    values = smoothed(ratios, sigma)
    return np.where(values >= values[clustered(values)].mean() / 2, sizes, 0.0)


def held(at: list[int], values, around: list[int]) -> list[float]:
    """What each element of a tree holds: the values of its lines and of all elements inside."""
    out = [0.0] * len(around)
    for node, value in zip(at, values, strict=True):
        out[node] += value
    for node in range(len(around) - 1, 0, -1):
        out[around[node]] += out[node]
    return out


def inherited(flags: list[bool], around: list[int], every: bool) -> list[bool]:
    """Whether a flag stands at an element or one around it; with ``every``, at it and all around it."""
    out = list(flags)
    for node in range(1, len(around)):
        out[node] = (out[node] and out[around[node]]) if every else (out[node] or out[around[node]])
    return out


def overruled(parser: Blocks, sigma: float, cover: float) -> set[int]:
    """Elements named away that hold the page's main text after all.

    They hold most of the selected text, and article or main elements outside have under a twentieth of it. If the name
    says nothing else ("comments", not "has-comments"), all that is in no such element must be under that, too.
    """
    weight = selected(parser.lines, sigma)
    names = [x[3] for x in parser.lines]
    marked = [len(x[0]) if parser.marked[x[2]] else 0 for x in parser.lines]
    bare = sum(len(x[0]) for x in parser.lines if not x[3])
    own, own_marked = held(names, weight.tolist(), parser.outer), held(names, marked, parser.outer)
    least, all_marked = cover * weight.sum(), sum(marked)
    return {n for n in range(1, len(parser.outer))
            if own[n] > least and not (parser.plain[n] and 20 * bare >= own[n]) and 20 * (all_marked - own_marked[n]) < own[n]}


def main_text(html: str | None, sigma: float = 1.0, cover: float = 0.5) -> str:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.end_block()
    lines = parser.lines
    stay = overruled(parser, sigma, cover) if any(x[3] for x in lines) else set()
    kept = inherited([n == 0 or n in stay for n in range(len(parser.outer))], parser.outer, every=True)
    lines = [x for x in lines if kept[x[3]]]
    if not lines:
        return ""
    weight = selected(lines, sigma)
    nodes, whole = [x[2] for x in lines], weight.sum()
    own, count = held(nodes, weight.tolist(), parser.parent), held(nodes, [1] * len(nodes), parser.parent)
    # articles hold the main text where a page has them, else the innermost container of all content; where a name
    # was overruled, nothing else is left out
    inner = range(len(parser.parent) - 1, 0, -1)
    region = next((n for n in inner if parser.kind[n] in ("article", "main") and own[n] > cover * whole), 0)
    if not region and not stay:
        region = next((n for n in inner if count[n] and own[n] >= whole), 0)
    within = inherited([n == region for n in range(len(parser.parent))], parser.parent, every=False)
    return " ".join(x[0] for x in lines if within[x[2]])


def extract(pages: DataFrame, html: str = "html", sigma: float = 1.0) -> DataFrame:
    """Add ``text`` (the main text) and ``n_chars`` (its code points) to all rows of ``pages``, without ``html``.

    Columns of these names are replaced. A null or empty page has an empty text. Unclosed and stray tags
    are taken as browsers mostly do; a page without markup is one line and its own main text. Pages of any length and
    depth are read whole, in time linear in their size. Repeated rows stay.
    """
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = StructType([*pages.select(*keep).schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x, sigma) for x in batch.column(html).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*keep, "text", "n_chars"])

    return arrow_rows(pages, schema, run)
