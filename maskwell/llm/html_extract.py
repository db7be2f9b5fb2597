"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard library's parser streams the page once. Every block-level tag ends a line. A
line's ratio is its text length over its number of tags; text inside links counts as tags do,
and text inside a region that is never article text (menus, forms, notices, ...) gives its
line a ratio of zero. Ratios are smoothed with a Gaussian over neighbouring lines of the
same region, and lines are clustered by a threshold (the standard deviation of the page's
smoothed ratios, at most their mean). Clusters select regions, not single lines: where
containers (``article``, ``main``) hold most of what is above the threshold, all of their
lines that are no boilerplate are the article, so that a short paragraph next to long ones
is kept. A container is left out only if most of its own text is links, however short it is;
if there is an article inside it, its other lines stay.

A region whose class, id or role has a boilerplate word is left out, unless the word is a part
of a name (``has-sidebar``) and the region holds most of the text above the threshold, or
nothing above the threshold is outside. Text of containers outside it speaks against it (a
quarter of all, as with long comments below an article). Words that also name parts of an
article (``WEAK``: ``form-group``, ``alert``) leave a region out only if nothing in it is above
the threshold; outside containers that holds for parts of names only. Buttons and labels
within a paragraph are words of it.

Work is linear in the page: open tags are found by name, and a line knows the innermost named
region, which knows the one around it.

Null pages are empty pages and give an empty text. Pages of any length are read whole.
Columns other than the page's html are passed on and never looked at.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main"
    " menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Never part of an article.
BOILERPLATE = set(
    "head title script style noscript template nav footer aside form button select textarea"
    " iframe svg canvas object audio video menu dialog input label option".split()
)
#: Words of class, id and role names of regions that are not the article.
WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment"
    " comments consent cookie cookies disqus footer form gdpr login masthead menu modal nav"
    " navbar navigation newsletter notice notices pagination popup promo promoted promotion"
    " related respond search share sharing sidebar signup social sponsor sponsored subscribe"
    " toolbar widget header replies topbar contentinfo complementary alert".split()
)
#: Those among them that name parts of articles as well.
WEAK = set("ad alert banner form header search share sharing social toolbar widget".split())
CONTAINERS = ("article", "main")
#: What a stray end tag cannot reach over.
WALLS = {*CONTAINERS, "body", "td", "table", "nav", "footer"}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def names(attrs: list[tuple[str, str | None]]) -> tuple[set[str], set[str]]:
    """Words of class, id and role names, and the whole names."""
    text = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
    return {x.lower() for x in _NAME.findall(text)}, set(text.lower().split())


class Lines(HTMLParser):
    """Collects lines: [text, tags, link characters, excluded, container, named regions]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, whether it starts an excluded region, whether it starts a named one
        self.open: list[tuple[str, bool, bool]] = []
        self.excluded = 0
        self.links = 0
        self.inside: list[int] = []  # numbers of the open containers
        self.parents = [0]  # the container around each one
        self.named: list[int] = []  # numbers of the open named regions
        self.whole: list[bool] = []  # for each named region, whether a whole name is the word
        self.weak: list[bool] = []  # whether all its words are weak, and the region is fit for it
        self.around: list[int] = []  # the named region around each one, or -1
        self.places: dict[str, list[int]] = {}  # where the open tags of each name stand
        self.walls: list[int] = []  # the same for WALLS and BLOCK
        self.blocks: list[int] = []
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            inside = self.inside[-1] if self.inside else 0
            region = self.named[-1] if self.named else -1
            paragraph = bool(self.places.get("p"))
            self.lines.append([text, self.tags, self.linked, self.excluded > 0, inside, region, paragraph])
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            self._close_open(tag)
        out = tag in BOILERPLATE or (tag == "header" and not self.inside)
        if tag in ("button", "label") and self.places.get("p"):
            out = False
        words, whole = names(attrs)
        named = not out and tag not in ("html", "body", *CONTAINERS) and bool(words & WORDS)
        if (out or named) and not self.excluded:
            self.end_line()
        self.excluded += out
        if named:
            exact = bool(whole & WORDS)
            self.around.append(self.named[-1] if self.named else -1)
            self.named.append(len(self.whole))
            self.whole.append(exact)
            self.weak.append(words & WORDS <= WEAK and bool(self.inside or not exact))
        self.links += tag == "a"
        if tag in CONTAINERS:
            self.parents.append(self.inside[-1] if self.inside else 0)
            self.inside.append(len(self.parents) - 1)
        for held in self._stacks(tag):
            held.append(len(self.open))
        self.open.append((tag, out, named))

    def _stacks(self, tag: str) -> list[list[int]]:
        """The lists of places that an open tag stands in."""
        own = [self.places.setdefault(tag, [])]
        return own + [self.walls] * (tag in WALLS) + [self.blocks] * (tag in BLOCK)

    def _close_open(self, tag: str) -> None:
        """A new item ends an open one of its kind in the same parent."""
        if self.blocks and self.open[self.blocks[-1]][0] == tag:
            self._pop(self.blocks[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        # A stray end tag closes nothing outside its region.
        if (at := self.places.get(tag)) and at[-1] >= (self.walls[-1] if self.walls else 0):
            self._pop(at[-1])

    def _pop(self, i: int) -> None:
        for tag, out, named in self.open[i:]:
            if (out and self.excluded == 1) or (named and not self.excluded):
                self.end_line()
            self.excluded -= out
            if named:
                self.named.pop()
            self.links -= tag == "a"
            if tag in CONTAINERS:
                self.inside.pop()
            for held in self._stacks(tag):
                held.pop()
        del self.open[i:]

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]
    return np.convolve(x, kernel)[reach : reach + len(x)] / weight


def smoothed_ratios(ratio: np.ndarray, out: np.ndarray, inside: np.ndarray, sigma: float) -> np.ndarray:
    """Ratios smoothed within each stretch of lines of one region; zero where ``out``."""
    smoothed = np.zeros(len(ratio))
    edges = np.flatnonzero(np.r_[True, (out[1:] != out[:-1]) | (inside[1:] != inside[:-1]), True])
    for a, b in zip(edges[:-1], edges[1:]):
        if not out[a]:
            smoothed[a:b] = smooth(ratio[a:b], sigma)
    return smoothed


def left_out(parser: Lines, ratio: np.ndarray, length: np.ndarray, sigma: float) -> np.ndarray:
    """Which lines are boilerplate, by their tags or by the names of their regions."""
    lines = parser.lines
    out = np.array([x[3] for x in lines])
    if not parser.whole:
        return out
    inside = np.array([x[4] for x in lines])
    smoothed = smoothed_ratios(np.where(out, 0.0, ratio), out, inside, sigma)
    above = np.where(~out & (smoothed >= min(smoothed.std(), smoothed.mean())), length, 0.0)
    total, contained = above.sum(), above[inside > 0].sum()
    held, own, rich = np.zeros((3, len(parser.whole)))
    # Without its neighbours' share: a row of buttons between paragraphs is not rich.
    alone = np.where(~out & (ratio >= min(smoothed.std(), smoothed.mean())), length, 0.0)
    region = np.array([x[5] for x in lines])
    named = region >= 0
    np.add.at(held, region[named], above[named])
    np.add.at(own, region[named], np.where(inside > 0, above, 0.0)[named])
    np.add.at(rich, region[named], alone[named])
    for r in range(len(held) - 1, -1, -1):  # inner regions have higher numbers
        if parser.around[r] >= 0:
            held[parser.around[r]] += held[r]
            own[parser.around[r]] += own[r]
            rich[parser.around[r]] += rich[r]
    article = (held > 0) & (
        np.isclose(held, total)
        | (~np.array(parser.whole) & (held > 0.5 * total) & (contained - own < 0.25 * total))
        | (np.array(parser.weak) & (rich > 0))
    )
    for r, outer in enumerate(parser.around):
        article[r] &= outer < 0 or article[outer]
    return out | (named & ~np.r_[article, True][region])


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article's blocks in page order, one per line; empty if there is none."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    length = np.array([len(x[0]) for x in lines], dtype=float)
    tags = np.array([x[1] for x in lines], dtype=float)
    linked = np.minimum(length, [x[2] for x in lines])
    inside = np.array([x[4] for x in lines])
    ratio = (length - linked) / np.maximum(1, tags + linked / 10)
    out = left_out(parser, ratio, length, sigma)
    ratio = np.where(out, 0.0, ratio)
    smoothed = smoothed_ratios(ratio, out, inside, sigma)
    chosen = ~out & (smoothed >= min(smoothed.std(), smoothed.mean()))
    mass = np.bincount(inside, weights=np.where(chosen, length, 0))
    named = mass[1:].sum()
    # A paragraph that is a link is a paragraph; other lines of links are menus and lists.
    mostly_links = (linked > 0.5 * length) & ~np.array([x[6] for x in lines])
    if named and named >= mass[0]:  # containers hold the article: take those regions whole
        of = [np.bincount(inside, np.where(out, 0, x), len(parser.parents)) for x in (length, linked)]
        rich = (of[0] > 0) & (of[1] <= 0.5 * of[0])
        rich[0] = False
        around = np.zeros(len(rich), dtype=bool)
        for c in range(len(rich) - 1, 0, -1):  # inner containers have higher numbers
            if rich[c] or around[c]:
                around[parser.parents[c]] = True
        around[0] = False
        chosen = ~out & (rich[inside] | (around[inside] & ~mostly_links))
    elif chosen.any():  # the region from the first to the last chosen line
        span = np.arange(len(lines))
        within = (span >= span[chosen][0]) & (span <= span[chosen][-1])
        heading = smoothed > 0  # short lines between chosen ones belong to them
        chosen = ~out & within & heading & ~mostly_links
    return "\n".join(x[0] for x, c in zip(lines, chosen) if c)


def extract(pages: DataFrame, html: str = "html", sigma: float = 1.0) -> DataFrame:
    """``pages`` with its main ``text`` and ``n_chars`` instead of ``html``.

    Columns of ``pages`` that are called text or n_chars are replaced.
    """

    @F.pandas_udf(T.StringType())
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, sigma) for x in column], dtype=object)

    kept = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    done = pages.select(*kept, of(F.col(html)).alias("text"))
    return done.withColumn("n_chars", F.char_length("text").cast("bigint"))
