"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser is fed the page; its events become lines, one for each block element,
with their characters, their tags since the line before and their element. Lines of all parts of the
page count: their text-to-tag ratios are smoothed with a Gaussian and cut in two clusters, and the
lines of the upper cluster vote for the content region (see ``chosen``). Lines in elements that never hold the article
(menus, forms, notices and the like, by tag, role, class or id) have no vote and are no output.

The region is the ``article`` or ``main`` elements that hold most of the votes; else the least element
around all votes, widened to its parents below the body as long as what a parent adds isn't mostly
links; else, where votes meet in the body alone, the lines from its first voting part to its last.
Every remaining line of the region is returned, short ones and links too; outside ``article`` and
``main`` runs of short lines that are mostly links, as menus have them, are not.

A null or empty page has an empty text, and so has one without text. Bytes that aren't UTF-8 count
as U+FFFD. Broken markup is read as the parser reads it; an element that is never closed ends with
its parent. The time is linear in the page, however long or deeply nested it is. Repeated rows are
read each on its own; other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from obsmill.llm.common import parts

#: Elements whose content isn't text of the page, and those whose text is never the article's.
MUTE_TAGS = frozenset("head script style noscript template iframe object svg canvas select textarea".split())
SKIP_TAGS = frozenset("nav footer aside form button dialog menu".split())
#: Words in class, id or role that mark such an element.
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert comment comments "
    "respond replies disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended "
    "newsletter subscribe signup popup modal overlay widget pagination pager contentinfo complementary search login toolbar skip".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Tags whose start ends an open element of their kind.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table div article main section body blockquote td".split())
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
LINK_SHARE = 0.5
#: Lines in a row of one parent, of so many words at most, that are mostly links and so a menu.
MENU_LINES, MENU_WORDS = 3, 4
_WORD = re.compile(r"[a-z]+")


class Lines(HTMLParser):
    """Collects lines as (text, characters of links, tags, element, whether it is aside); elements are numbers, with their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = []  # tag, element, 1 aside and 2 mute, whether it bounds what a start tag closes
        self.open: dict[str, list[int]] = {}  # by tag its places in the stack
        self.scopes: list[int] = []
        self.mute = self.aside = self.links = self.inside = self.tags = 0
        self.parents = [0]
        self.mains: set[int] = set()
        self.pages: set[int] = {0}
        self.line: list[str] = []
        self.linked = 0
        self.lines: list[tuple[str, int, int, int, bool]] = []

    def end_line(self) -> None:
        if self.line:
            if text := " ".join("".join(self.line).split()):
                self.lines.append((text, self.linked, self.tags, self.stack[-1][1] if self.stack else 0, self.aside > 0))
                self.tags = 0
            self.line, self.linked = [], 0

    def _kind(self, tag: str, attrs) -> int:
        if tag in MUTE_TAGS:
            return 2
        kind = int(tag in SKIP_TAGS or tag == "header" and not self.inside)
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return 2
            if value and name in ("class", "id", "role") and tag not in ("html", "body") and not SKIP_WORDS.isdisjoint(_WORD.findall(value.lower())):
                kind = 1
        return kind

    def handle_starttag(self, tag, attrs):
        self.tags += not self.mute
        if tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                self.end_line()
            elif self.line:
                self.line.append(" " if tag == "br" else "")
            return
        if tag in BLOCK_TAGS:
            self.end_line()
        if tag in SELF_CLOSING:
            self._close_before(SELF_CLOSING[tag])
        kind = self._kind(tag, attrs)
        if kind and self.line and not self.aside and not self.mute:
            self.end_line()  # what is aside is a line of its own
        self.parents.append(self.stack[-1][1] if self.stack else 0)
        number = len(self.parents) - 1
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in _SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, number, kind, tag in _SCOPES))
        self.mute += kind == 2
        self.aside += kind == 1
        self.links += tag == "a"
        if tag in ("html", "body"):
            self.pages.add(number)
        if tag in MAIN_TAGS:
            self.inside += 1
            if not self.mute and not self.aside:
                self.mains.add(number)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def _close_before(self, tags) -> None:
        last = max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)
        if last >= 0 and last >= (self.scopes[-1] if self.scopes else -1):
            self._pop(last)

    def _pop(self, k: int) -> None:
        for tag, _, kind, scope in reversed(self.stack[k:]):
            if kind == 1 and self.aside == 1 and not self.mute:
                self.end_line()
            self.mute -= kind == 2
            self.aside -= kind == 1
            self.links -= tag == "a"
            self.inside -= tag in MAIN_TAGS
            self.open[tag].pop()
            if scope:
                self.scopes.pop()
        del self.stack[k:]

    def handle_endtag(self, tag):
        self.tags += not self.mute
        if tag in BLOCK_TAGS:
            self.end_line()
        if self.open.get(tag):
            self._pop(self.open[tag][-1])

    def handle_data(self, data):
        if not self.mute:
            self.line.append(data)
            if self.links:
                self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, with the weights that fall outside left out."""
    reach = min(math.ceil(3 * sigma), max(0, len(values) - 1))
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(values, weights)[reach : reach + len(values)] / np.convolve(np.ones(len(values)), weights)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """Between the means of two clusters (one-dimensional 2-means from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        upper = values > (low + high) / 2
        if upper.all() or not upper.any() or (means := (float(values[~upper].mean()), float(values[upper].mean()))) == (low, high):
            break
        low, high = means
    return (low + high) / 2


def chosen(lines: list[tuple[str, int, int, int, bool]]) -> list[bool]:
    """Whether each line votes: its own ratio is that of the upper cluster, and its smoothed one too or that of such a line nearby.

    A long line by itself among menus has a low smoothed ratio, a short line beside the article a low
    one of its own; the article's first and last lines lose some of theirs to what is around.
    """
    ratio = np.array([len(text) / max(1, tags) for text, _, tags, _, _ in lines])
    blurred = smooth(ratio)
    cut = threshold(blurred)
    reach = math.ceil(3 * SIGMA)
    near = np.convolve((blurred >= cut) & (ratio >= cut), np.ones(2 * reach + 1))[reach : reach + len(lines)] > 0.5
    return (near & (ratio >= cut)).tolist()


def _totals(parents: list[int], lines, amounts: list[int]) -> list[int]:
    """For each element the sum over the lines in it."""
    total = [0] * len(parents)
    for x, amount in zip(lines, amounts, strict=True):
        total[x[3]] += amount
    for e in range(len(parents) - 1, 0, -1):  # a parent's number is smaller
        total[parents[e]] += total[e]
    return total


def _within(parents: list[int], roots) -> list[bool]:
    """For each element whether it is one of the roots or in one."""
    inside = [e in roots for e in range(len(parents))]
    for e in range(1, len(parents)):
        inside[e] = inside[e] or inside[parents[e]]
    return inside


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines, parents = parser.lines, parser.parents
    if all(x[4] for x in lines):
        return ""
    size = [0 if x[4] else len(x[0]) for x in lines]
    votes = [n * up for n, up in zip(size, chosen(lines), strict=True)]
    if not any(votes):  # the upper cluster is all aside
        votes = size
    voted, whole = _totals(parents, lines, votes), sum(votes)
    inside = _within(parents, parser.mains)
    if parser.mains and 2 * sum(v for x, v in zip(lines, votes, strict=True) if inside[x[3]]) >= whole:
        region = _within(parents, {e for e in parser.mains if voted[e]})
        return "\n".join(x[0] for x in lines if region[x[3]] and not x[4])
    root = max(e for e, v in enumerate(voted) if v == whole)  # numbers grow inwards
    if root in parser.pages:
        top = list(range(len(parents)))  # of each element the part of the page that it is in
        for e in range(1, len(parents)):
            if parents[e] not in parser.pages:
                top[e] = top[parents[e]]
        voting = [k for k, v in enumerate(votes) if v]
        ends = {top[lines[k][3]] for k in (voting[0], voting[-1])} - parser.pages
        held = [k for k, x in enumerate(lines) if top[x[3]] in ends] + [voting[0], voting[-1]]
        rest = lines[min(held) : max(held) + 1]
    else:
        linked, chars = _totals(parents, lines, [0 if x[4] else x[1] for x in lines]), _totals(parents, lines, size)
        while (up := parents[root]) not in parser.pages and linked[up] - linked[root] <= LINK_SHARE * (chars[up] - chars[root]):
            root = up
        region = _within(parents, {root})
        rest = [x for x in lines if region[x[3]]]
    return "\n".join(_without_menus([x for x in rest if not x[4]], parents))


def _without_menus(lines: list[tuple[str, int, int, int, bool]], parents: list[int]) -> list[str]:
    short = [linked >= LINK_SHARE * len(text) and len(text.split()) <= MENU_WORDS for text, linked, *_ in lines]
    out = []
    for (link, _), run in groupby(zip(lines, short, strict=True), key=lambda x: (x[1], parents[x[0][3]])):
        texts = [x[0] for x, _ in run]
        if not link or len(texts) < MENU_LINES:
            out += texts
    return out


def extract_pages(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the kept columns, text, n_chars (code points)."""
    fields = [pages.schema[c] for c in keep]
    schema = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))

    def run(batches):
        for b in batches:
            for i, some in parts(b.column(len(fields))):
                found = [main_text(x) if x else "" for x in some]
                yield pa.record_batch([*(b.column(k).slice(i, len(some)) for k in range(len(fields))), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*(f"k{k}" for k in range(len(fields))), "text", "n"])

    out = pages.select(*(pages[c].alias(f"k{i}") for i, c in enumerate(keep)), pages[html_col].alias("html")).mapInArrow(run, f"{schema}, text string, n_chars long")
    return out.toDF(*keep, "text", "n_chars")
