"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Pages that fit the text model, at most: those first by a hash of the id.
FIT_PAGES = 300
#: Capacity of an edge between neighbours in page order, and between neighbours in one container.
ADJACENT, CONTAINED = 0.6, 1.6
#: What a block's text can weigh, and what its nearest named element weighs by its tag or by its class. Elements farther out
#: weigh less: a part of another kind inside an article is seldom rescued by it, an article inside one is doubtful.
TEXT_LIMIT = 2.0
BY_TAG, BY_CLASS = 4.5, 4.0
OUTER_CONTENT, OUTER_CHROME = 0.2, 0.6

# Names of HTML, and words that name parts of pages in class, id and role attributes.
SKIPPED = frozenset("script style noscript template title svg iframe object select option button textarea canvas audio video map dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("html body caption td th tr tbody thead tfoot li dd dt legend summary".split())
CONTAINERS = frozenset("article aside body details dialog div fieldset footer form header main menu nav ol search section table td ul".split())
HEADINGS, ITEMS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("li dt dd td th".split())
CONTENT_TAGS, CHROME_TAGS = frozenset("article main".split()), frozenset("nav footer aside form menu search fieldset header".split())
CONTENT_WORDS = frozenset("article post entry story content main articlebody body text maincontent prose".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist contentinfo complementary consent cookie cookies copyright dialog disclaimer "
    "disqus footer foot gdpr head header login masthead menu menubar message modal nav navbar navigation newsletter notice notification pager pagination paywall popup privacy promo promoted promotion rail "
    "recommended related replies reply respond search share sharing sidebar side signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar tracking widget widgets".split()
)
#: Words that turn a class into a statement about its element, or name what a part leads to: has-sidebar, no-comments, ad-free, side-by-side, search-results.
MODIFIERS = frozenset("has have no not without with hide hidden show shown is free less enabled disabled by result results".split())
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")


def named(value: str) -> tuple[bool, bool]:
    """Whether class, id or role names say content, and whether they say another part of a page.

    A name counts as a whole: by its first and last word (``site-header``, ``comment-body``), and for
    nothing where a word of it is a modifier.
    """
    content = chrome = False
    for name in value.split():
        words = NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if not words or MODIFIERS & set(words):
            continue
        ends = {words[0], words[-1]}
        chrome |= bool(ends & CHROME_WORDS)
        content |= bool(ends & CONTENT_WORDS) and not ends & CHROME_WORDS
    return content, chrome


@dataclass
class Block:
    text: str
    container: int
    place: float  # what stands around: above 0 for an article, below for other parts of a page
    clear: bool  # whether all that stands around says the same
    heading: bool
    item: bool
    link_chars: int


@dataclass
class _Open:
    """An open element: its tag and container, what the nearest named element says (above 0 for content), and the least and the most that any says."""

    tag: str
    container: int
    nearest: float = 0.0
    least: float = 0.0
    most: float = 0.0

    def place(self) -> float:
        """What the named elements around weigh together."""
        return self.nearest + (OUTER_CHROME * self.least if self.nearest > 0 else OUTER_CONTENT * self.most if self.nearest < 0 else 0.0)


class _Blocks(HTMLParser):
    """Splits a page into blocks of text, each with what stands around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("", 0)]
        self.containers = 0
        self.skip: list[str] = []
        self.link = 0
        self.parts: list[str] = []
        self.link_chars = 0
        self.blocks: list[Block] = []

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            at, tags = self.stack[-1], {e.tag for e in self.stack[-2:]}
            clear = (at.least < 0) != (at.most > 0)
            self.blocks.append(Block(text, at.container, at.place(), clear, bool(tags & HEADINGS), bool(tags & ITEMS), min(self.link_chars, len(text))))
        self.parts, self.link_chars = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag in SKIPPED:
            self.parts.append(" ")
            self.skip.append(tag)
            return
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.link += 1
        if tag not in BLOCKS:
            return
        self.flush()
        if tag in CLOSES_P:
            self._close("p")
        if tag in ITEMS or tag == "tr":
            self._close(tag)
        if tag == "hr":
            return
        outer = self.stack[-1]
        self.containers += tag in CONTAINERS
        container = self.containers if tag in CONTAINERS else outer.container
        weighed = self._weigh(tag, attrs, outer.nearest > 0)
        self.stack.append(_Open(tag, container, weighed or outer.nearest, min(outer.least, weighed), max(outer.most, weighed)))

    def _weigh(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> float:
        """What an element says of its blocks; its own tag comes before its names. ``inside`` an article a header is the article's own."""
        content = chrome = hidden = False
        for k, v in attrs:
            if k == "id" and (tag == "section" or tag in HEADINGS):
                continue  # an anchor, which says what the text is about
            if k in ("class", "id", "role", "aria-label", "itemprop") and v:
                says = named(v)
                content, chrome = content or says[0], chrome or says[1]
            hidden |= k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and bool(v) and "display:none" in v.replace(" ", "").lower())
        if hidden:
            return -2 * BY_TAG
        if tag in CONTENT_TAGS:
            return BY_TAG
        if tag in CHROME_TAGS and not (tag == "header" and inside):
            return -BY_TAG
        if tag in ("body", "html"):
            return 1.0 if content else 0.0
        return -BY_CLASS if chrome else BY_CLASS if content else 0.0

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED and self.skip[-1:] == [tag]:
            self.skip.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
                return
            if tag not in BLOCKS or all(e.tag != tag for e in self.stack):
                return
            self.skip = []  # an element around the one that was never closed ends
        if tag == "a":
            self.link = max(0, self.link - 1)
        if tag in BLOCKS:
            self.flush()
            self._close(tag)

    def _close(self, tag: str) -> None:
        """Leave the innermost open ``tag``, if it lies inside the nearest container."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if (tag in ("p", "tr") or tag in ITEMS) and self.stack[i].tag in CONTAINERS:
                return

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if self.link:
                self.link_chars += len(data)


def blocks_of(html: str | None) -> list[Block]:
    """Blocks of text in page order; a page that ends inside a tag or a comment gives what came before."""
    parser = _Blocks()
    parser.feed(html or "")
    if not parser.rawdata.startswith("<!--"):
        parser.close()
    parser.flush()
    return parser.blocks


def features(b: Block) -> list[float]:
    """What the text alone tells: constant, logarithm of the words, share of link text, sentence ends, heading, list item."""
    words = b.text.count(" ") + 1
    return [1.0, math.log(words), b.link_chars / len(b.text), float(b.text[-1] in ".!?…\"'"), float(b.heading), float(b.item)]


def train(pages: list[str | None]) -> np.ndarray:
    """Fit the text model on blocks whose surroundings agree on what they are, by Newton steps with a small penalty."""
    rows = [(features(b), b.place > 0) for p in pages for b in blocks_of(p) if b.clear]
    n = 6
    w = np.zeros(n)
    if len({y for _, y in rows}) < 2:
        return w
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (q * (1 - q) + 1e-6)) @ x + np.eye(n), x.T @ (y - q) - w)
    return w


def gains(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """How much better each block is kept than left: its surroundings and, within a limit, its text."""
    text = np.clip(np.array([features(b) for b in blocks]) @ weights, -TEXT_LIMIT, TEXT_LIMIT)
    return [b.place + float(t) for b, t in zip(blocks, text, strict=True)]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order and between neighbours in one container."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if b.container in last:
            edges.append((last[b.container], i, CONTAINED))
        last[b.container] = i
    return edges


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut.

    A node costs its positive gain if cut from the source, its negative gain if
    cut from the sink; an edge costs its capacity when its ends part. A node whose gain exceeds
    its edges together is settled, and its edges become gains of its neighbours; the rest
    is cut by augmenting shortest paths, one node of the source's at a time. What cannot reach
    the sink never will, so it is not searched again.
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if side[v] is None and abs(gain[v]) >= sum(near[v].values()):
            side[v] = gain[v] > 0
            for u, c in near[v].items():
                gain[u] += c if side[v] else -c
                del near[u][v]
                todo.append(u)
            near[v] = {}
    rest = [v for v in range(n) if side[v] is None]
    room = {v: dict(near[v]) for v in rest}
    supply = {v: max(gain[v], 0.0) for v in rest}
    demand = {v: max(-gain[v], 0.0) for v in rest}
    closed: set[int] = set()
    for start in rest:
        while supply[start] > 1e-9 and start not in closed:
            came, queue, end = {start: start}, deque([start]), None
            while queue:
                v = queue.popleft()
                if demand[v] > 1e-9:
                    end = v
                    break
                for u, c in room[v].items():
                    if c > 1e-9 and u not in came and u not in closed:
                        came[u] = v
                        queue.append(u)
            if end is None:
                closed.update(came)
                break
            path, v = [], end
            while v != start:
                path.append((came[v], v))
                v = came[v]
            flow = min([supply[start], demand[end], *[room[a][b] for a, b in path]])
            supply[start] -= flow
            demand[end] -= flow
            for a, b in path:
                room[a][b] -= flow
                room[b][a] += flow
    reached = deque(v for v in rest if supply[v] > 1e-9)
    kept = set(reached)
    while reached:
        for u, c in room[reached.popleft()].items():
            if c > 1e-9 and u not in kept:
                kept.add(u)
                reached.append(u)
    for v in rest:
        side[v] = v in kept
    return [bool(s) for s in side]


def extract(html: str | None, weights: np.ndarray) -> str:
    """Blocks on the content side of the cut, one a line."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(blocks, min_cut(gains(blocks, weights), edges_of(blocks)), strict=True) if keep)


def train_on(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES, seed: int = 42) -> np.ndarray:
    """Fit the text model on at most ``fit_pages`` pages, first by a hash of the id."""
    ids = F.broadcast(pages.select(F.col(id_col).alias("__id")).orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(fit_pages).distinct())
    rows = pages.select(F.col(id_col).alias("__id"), F.col(html_col).alias("html")).join(ids, "__id").orderBy(F.xxhash64("__id", F.lit(seed)), F.xxhash64("html")).limit(fit_pages).collect()
    return train([r["html"] for r in rows])


def main_text(html: Column, weights: np.ndarray) -> Column:
    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([extract(h, weights) for h in s], dtype=object)

    return extracted(html)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES, out_col: str = "text") -> DataFrame:
    """Add the main text of each page; an input column of that name is replaced.

    A page is cut into blocks of text; character references are decoded, white space
    inside a block becomes one space. Named elements around a block, the nearest first, speak for the
    content side (articles) or against it (menus, headers, footers, side bars, notices, adverts, forms and
    reader comments), and so does its text by a model that is fitted on a bounded sample; edges
    between neighbours in page order and in one container make the labels
    smooth. The minimum cut decides; where little stands around a block, its neighbours outvote its text. A null or empty page, or one without content, gives an
    empty text. Rows with null ids are worked like others. Nothing is shuffled. Repeated rows have the same text each; a very long page is worked on whole,
    as one row of a task. An empty table gives an empty result.
    """
    weights = train_on(pages, id_col, html_col, fit_pages)
    return bound_batches(pages).withColumn(out_col, main_text(F.col(html_col), weights))
