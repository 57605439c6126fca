"""Operator 7: main text by a tree-structured graphical model over the DOM.

Every element is a binary node (content or not). Unary potentials are naive Bayes
over tag, class and id words, text length and link density; potentials between
parent and child say how content and boilerplate nest, apart for children that stand or
name themselves apart, and for children that name themselves as content. Sum-product messages run upward and downward once,
and a text block is kept if its element's content marginal is over one half. The
potentials are counted on labelled pages.

Labels come from pages with an article or main element: elements below it are content,
except below elements that stand or name themselves apart (menus, notices, comments),
whose text mostly links elsewhere, or whose text is repeated on several pages of the
sample. Pages without such an element are not used for training.

Names are evidence about a part of a page, not about all of it: an article's own header
is part of it, a word that also names content or a state of the page marks nothing, and
names that would leave a page with hardly any running text are not believed, except
those of comments, menus and footers. If no block of a page reaches one half, the element
that holds its running text is taken as content and the messages run again.

Pages nested to any depth are read in linear time. ``keep`` columns come as struct
``_row``, so no name in them can clash with the results. Repeated pages each give their
own row; an empty table gives no rows.

Null html counts as empty and gives empty text. Character references are decoded,
white space inside a block becomes one space, blocks are joined by an empty line;
nothing else is dropped or capped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import hash_sample, prepare

# Fixed HTML vocabulary: elements without end tags, without text for readers, and block-level ones.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "select", "textarea",
          "button", "title"}
# What a head may hold; any other start tag, or text, ends a head whose end tag is left out.
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
         "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
         "td", "tfoot", "th", "thead", "tr", "ul"}
# A start tag closes an open element of these kinds, up to the barrier elements.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"ul", "ol", "dl", "table", "menu"}
# Names by which elements call themselves something else than content, or content.
OUTSIDE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
OUTSIDE_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
                 "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "masthead", "menu",
                 "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo",
                 "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "share", "sharing",
                 "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
INSIDE_TAGS = {"article", "main"}
# Names that are believed whatever they leave, and words that make a name tell a state of the page instead of a part.
SURE_TAGS = {"nav", "footer", "form", "menu", "dialog"}
SURE_WORDS = {"comment", "comments", "replies", "respond", "disqus", "nav", "navbar", "navigation", "footer", "cookie", "cookies"}
STATE_WORDS = {"enabled", "disabled", "has", "no", "is", "with", "without", "open", "closed", "active", "supports", "type", "format"}
# Running text: blocks of so many characters of which less than a third are links.
RUNNING_CHARS = 80
# Share of a page's running text that names must leave to be believed.
LEAST_LEFT = 0.1
# Pages of the sample on which a text of a block must stand to count as repeated.
REPEATED = 3
INSIDE_WORDS = {"article", "body", "content", "entry", "main", "post", "story"}
# How an element names itself decides which parent-child potential applies.
GENERIC, NAMED_OUTSIDE, NAMED_INSIDE = 0, 1, 2
# Share of every class that each feature is given beforehand: one feature counts for 1 / FEATURE_PRIOR at most.
FEATURE_PRIOR = 0.2
# Elements of a kind's overall mix that are added to each parent state, and to the kind itself for its class.
PAIR_PRIOR, KIND_PRIOR = 5.0, 50.0

# A start tag that gives a page labels.
MARKED = r"(?i)<(article|main)[\s/>]"

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    # The words of each whole class, id or role.
    tokens: tuple[tuple[str, ...], ...] = ()
    text_chars: int = 0
    link_chars: int = 0
    blocks: int = 0


class Page(HTMLParser):
    """The element tree of a page and its text blocks in page order, each with its element's number.

    Silent elements that turn out to have no end tag of their own hide text up to the
    next block-level element only; the page is then read a second time, knowing them.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self._unclosed: set[int] = set()
        self._read(html)
        if self._implied:
            self._unclosed = self._implied
            self.reset()
            self._read(html)

    def _read(self, html: str) -> None:
        self.nodes = [Node("#page", -1)]
        self.blocks: list[tuple[int, str]] = []
        self._stack = [0]
        self._open: dict[str, list[int]] = {}  # places on the stack of the open elements, by tag
        self._block_at, self._silent_at = [], []
        self._silent = 0
        self._links = 0
        self._text: list[str] = []
        self._owner = 0
        self._implied: set[int] = set()  # silent elements that ended without an end tag
        self._kinds: list[int] | None = None
        self.feed(html)
        self.close()
        self._end_block()
        self._implied.update(k for k in self._stack if self.nodes[k].tag in SILENT)

    def _end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self._text)).strip()
        self._text = []
        if text:
            self.blocks.append((self._owner, text))
            self.nodes[self._owner].blocks += 1

    def _end_silent(self, tag: str) -> None:
        """End the silent elements that ``tag`` cannot stand in."""
        if tag == "body" and self._open.get("head"):
            self._close("head")
        while self._silent:
            k = self._stack[self._silent_at[-1]]
            if not (tag in BLOCK and k in self._unclosed) and not (self.nodes[k].tag == "head" and tag not in IN_HEAD):
                return
            self._close(self.nodes[k].tag)

    def handle_starttag(self, tag, attrs):
        if self._silent:
            self._end_silent(tag)
        if tag in BLOCK:
            self._end_block()
            if self._last({"p"}) > self._last({"button", "td", "th", "caption", "html"}):
                self._close("p")
        if tag in CLOSES:
            while (at := self._last(CLOSES[tag])) > self._last(BARRIERS):
                self._close(self.nodes[self._stack[at]].tag)
        if tag in VOID:
            if tag in ("br", "hr"):
                self._text.append(" ")
            return
        tokens = tuple(words for k, v in attrs if k in ("class", "id", "role") and v for t in v.split()
                       if (words := tuple(_NAME.findall(_CAMEL.sub("-", t).lower()))))
        self.nodes.append(Node(tag, self._stack[-1], tuple(w for words in tokens for w in words), tokens))
        place = len(self._stack)
        self._open.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self._block_at.append(place)
        if tag in SILENT:
            self._silent_at.append(place)
        self._stack.append(len(self.nodes) - 1)
        self._silent += tag in SILENT
        self._links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and tag != "a":
            self.handle_endtag(tag)

    def _last(self, tags: set[str]) -> int:
        """The place on the stack of the last open element of these kinds; 0 if none is open."""
        return max((places[-1] for t in tags if (places := self._open.get(t))), default=0)

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_block()
        while len(self._stack) > 1:
            k = self._stack.pop()
            node = self.nodes[k]
            self._open[node.tag].pop()
            if node.tag in BLOCK:
                self._block_at.pop()
            if node.tag in SILENT:
                self._silent_at.pop()
            self._silent -= node.tag in SILENT
            if node.tag in SILENT and node.tag != tag:
                self._implied.add(k)
            self._links -= node.tag == "a"
            if node.tag == tag:
                return

    def handle_endtag(self, tag):
        if self._open.get(tag):
            self._close(tag)

    def handle_data(self, data):
        if self._silent and self.nodes[self._stack[-1]].tag == "head" and data.strip():
            self._close("head")
        if self._silent:
            return
        owner = self._stack[self._block_at[-1]] if self._block_at else 0
        if owner != self._owner:
            self._end_block()
            self._owner = owner
        self._text.append(data)
        n = len(data.strip())
        self.nodes[owner].text_chars += n
        self.nodes[owner].link_chars += n if self._links else 0


def features(page: Page, k: int) -> list[str]:
    node = page.nodes[k]
    out = [f"t:{node.tag}"] + [f"n:{w}" for w in set(node.names)]
    if node.text_chars:
        out.append(f"len:{min(12, int(math.log2(node.text_chars)))}")
        out.append(f"link:{round(4 * node.link_chars / node.text_chars)}")
    return out


def _named_outside(node: Node, words: set[str]) -> bool:
    """Whether a whole class, id or role of the element has one of the words and names no state; content too only beside sure words."""
    if node.tag in ("html", "body"):
        return False
    return any(not words.isdisjoint(t) and STATE_WORDS.isdisjoint(t) and (INSIDE_WORDS.isdisjoint(t) or not SURE_WORDS.isdisjoint(t)) for t in node.tokens)


def _running(node: Node) -> int:
    return node.text_chars if node.text_chars >= RUNNING_CHARS and 3 * node.link_chars < node.text_chars else 0


def kinds(page: Page) -> list[int]:
    """How every element names itself, as far as the page's text lets it be believed."""
    if page._kinds is not None:
        return page._kinds
    nodes, out = page.nodes, []
    within = []  # below an article or main element that is not itself apart
    for k, node in enumerate(nodes):
        above = within[node.parent] if k else False
        apart = node.tag in OUTSIDE_TAGS and not (node.tag == "header" and above)
        words = OUTSIDE_WORDS if node.tag not in INSIDE_TAGS else SURE_WORDS
        if apart or _named_outside(node, words):
            out.append(NAMED_OUTSIDE)
        else:
            out.append(NAMED_INSIDE if node.tag in INSIDE_TAGS or not INSIDE_WORDS.isdisjoint(node.names) else GENERIC)
        within.append((above or node.tag in INSIDE_TAGS) and out[-1] != NAMED_OUTSIDE)
    total = left = 0
    apart = []
    for k, node in enumerate(nodes):
        apart.append(out[k] == NAMED_OUTSIDE or (k > 0 and apart[node.parent]))
        total += _running(node)
        left += 0 if apart[k] else _running(node)
    if left < LEAST_LEFT * total:
        for k, node in enumerate(nodes):
            if out[k] == NAMED_OUTSIDE and node.tag not in SURE_TAGS and not _named_outside(node, SURE_WORDS):
                out[k] = GENERIC
    page._kinds = out
    return out


def labels(page: Page, repeated: set[str] = frozenset()) -> list[int] | None:
    """1 for content elements, 0 for others; None if the page does not tell."""
    if not any(n.tag in INSIDE_TAGS for n in page.nodes):
        return None
    again = Counter()
    for k, text in page.blocks:
        again[k] += text in repeated
    out = []
    for k, (node, named) in enumerate(zip(page.nodes, kinds(page))):
        above = out[node.parent] if k else 0
        links = node.text_chars > 0 and 2 * node.link_chars > node.text_chars
        same = node.blocks > 0 and again[k] == node.blocks
        out.append(int((above or node.tag in INSIDE_TAGS) and named != NAMED_OUTSIDE and not links and not same))
    return out


def running_text_root(page: Page) -> int | None:
    """The lowest element that holds most of the page's running text outside of what names itself apart; None if there is none."""
    own = kinds(page)
    apart, held = [], []
    for k, node in enumerate(page.nodes):
        apart.append(own[k] == NAMED_OUTSIDE or (k > 0 and apart[node.parent]))
        held.append(0 if apart[k] else _running(node))
    own_text = list(held)
    heaviest = [0] * len(held)
    for k in range(len(held) - 1, 0, -1):
        parent = page.nodes[k].parent
        held[parent] += held[k]
        if held[k] >= held[heaviest[parent]] or heaviest[parent] == 0:
            heaviest[parent] = k
    if not held[0]:
        return None
    at = 0
    while heaviest[at] and held[heaviest[at]] >= 0.8 * held[at] and not own_text[heaviest[at]]:
        at = heaviest[at]
    return at


@dataclass
class TreeModel:
    """Log potentials: per feature (other, content), per child kind and state given the parent's, and for the root."""

    unary: dict[str, tuple[float, float]]
    unseen: tuple[float, float]
    pair: list[list[list[float]]]
    root: tuple[float, float]

    def marginals(self, page: Page, content: int | None = None) -> list[float]:
        """P(content) of every element: leaves to root, then root to leaves. The element ``content`` is taken as content."""
        n, kind = len(page.nodes), kinds(page)
        own = []
        for k in range(n):
            a = b = 0.0
            for f in features(page, k):
                x, y = self.unary.get(f, self.unseen)
                a += x
                b += y
            own.append([a, b])
        own[0] = [own[0][0] + self.root[0], own[0][1] + self.root[1]]
        if content is not None:
            own[content][0] -= 1000.0
        belief = [list(x) for x in own]  # own potential and all messages from below
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for k in range(n - 1, 0, -1):  # children come after their parents
            b, pair = belief[k], self.pair[kind[k]]
            up[k] = (_add(pair[0][0] + b[0], pair[0][1] + b[1]), _add(pair[1][0] + b[0], pair[1][1] + b[1]))
            above = belief[page.nodes[k].parent]
            above[0] += up[k][0]
            above[1] += up[k][1]
        for k in range(1, n):
            above = belief[page.nodes[k].parent]  # by now with the message from above
            a, b = above[0] - up[k][0], above[1] - up[k][1]
            pair = self.pair[kind[k]]
            belief[k][0] += _add(a + pair[0][0], b + pair[1][0])
            belief[k][1] += _add(a + pair[0][1], b + pair[1][1])
        return [1 / (1 + math.exp(max(-700.0, min(700.0, b[0] - b[1])))) for b in belief]


def _add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def train(pages: list[str]) -> TreeModel:
    """Count the potentials on labelled pages, over the priors above."""
    seen: Counter = Counter()
    state = [1.0, 1.0]
    pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(3)]
    read = [Page(html) for html in pages]
    on = Counter(text for page in read for text in {t for _, t in page.blocks})
    repeated = {text for text, n in on.items() if n >= REPEATED}
    for page in read:
        found = labels(page, repeated)
        if found is None:
            continue
        kind = kinds(page)
        for k, y in enumerate(found):
            state[y] += 1
            if k:
                pair[kind[k]][found[page.nodes[k].parent]][y] += 1
            for f in features(page, k):
                seen[f, y] += 1
    rate = lambda f, y: math.log((seen[f, y] / state[y] + FEATURE_PRIOR) / (1 + FEATURE_PRIOR))
    logs = []
    for which, rows in enumerate(pair):
        mix = [rows[0][y] + rows[1][y] + 1 for y in (0, 1)]
        if which != GENERIC:
            mix[which == NAMED_INSIDE] += KIND_PRIOR
        own = [[(rows[x][y] + PAIR_PRIOR * mix[y] / sum(mix)) for y in (0, 1)] for x in (0, 1)]
        if which == GENERIC:  # without any labelled page, elements still follow their parents
            own[0][0], own[1][1] = own[0][0] + KIND_PRIOR, own[1][1] + KIND_PRIOR
        logs.append([[math.log(v / sum(row)) for v in row] for row in own])
    return TreeModel(
        unary={f: (rate(f, 0), rate(f, 1)) for f in {f for f, _ in seen}},
        unseen=(0.0, 0.0),
        pair=logs,
        root=(math.log(0.99), math.log(0.01)),
    )


def main_text(html: str | None, model: TreeModel) -> str:
    if not html:
        return ""
    page = Page(html)
    chance = model.marginals(page)
    if all(chance[k] <= 0.5 for k, _ in page.blocks) and (root := running_text_root(page)) is not None:
        chance = model.marginals(page, root)
    return "\n\n".join(text for k, text in page.blocks if chance[k] > 0.5)


def extract(pages: DataFrame, keep: list[str], html: str = "html", train_pages: int = 500) -> DataFrame:
    """``keep`` columns of every page as struct ``_row`` with ``text`` and ``n_chars`` (code points).

    The model is fitted to about ``train_pages`` of the pages that can have labels, taken by hash.
    """
    prepare(pages.sparkSession)
    marked = pages.filter(F.col(html).rlike(MARKED)).select(F.col(html).alias("_h"))
    chosen = hash_sample(marked, "_h", train_pages).collect()
    model = train([r["_h"] for r in chosen])

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h if isinstance(h, str) else None, model) for h in batch.tolist()], dtype=object)

    out = pages.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), text_of(F.col(html)).alias("_text"))
    return out.select("_row", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
