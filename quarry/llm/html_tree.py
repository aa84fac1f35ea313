"""Main text of web pages from a tree-structured graphical model over the DOM.

Nodes are elements that can hold a block of text. Each is content or boilerplate; its potential comes from tag, class
and id words, link and text density and place, and every parent and child have a potential for each pair of labels.
Sum-product messages go up to the root and down again and give every node's content marginal; text directly in nodes of at least
one half is kept, in page order.

The model is fitted by maximum likelihood on labelled pages. The corpus has none, so they are composed here, from layouts that
sites commonly use with the label of every part known; words are random, and no word of a text is a feature.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.html_pages import Composer

PAGES = 500  # labelled pages that are composed for fitting
STEPS, RATE, DECAY = 400, 0.2, 1e-4

# ---- DOM

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags whose text is never content.
DROPPED = frozenset("script style textarea noscript iframe template select option button svg canvas object head title".split())
#: An open p ends before these; an li, dt, dd, tr, td, th or option ends before one of its own kind.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_MARKUP = re.compile(r"<(?=[A-Za-z!?/])")
_TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_GAP, _KEY, _EQUALS, _BARE = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_COMMENT_END = re.compile(r"--!?>")
#: Tags of one kind: each ends the other.
_ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_SPACE = re.compile(r"[\s]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    hidden: bool = False
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (place in the page, text) directly in it
    chars: int = 0
    links: int = 0
    n_links: int = 0
    children: int = 0


def _skipped(page: str, at: int) -> int:
    """The place after a comment, declaration or stray end tag that begins at `at`."""
    if page.startswith("<!--", at):
        for early in ("<!-->", "<!--->"):
            if page.startswith(early, at):
                return at + len(early)
        end = _COMMENT_END.search(page, at + 4)
        return end.end() if end else len(page)
    end = page.find(">", at)
    return end + 1 if end >= 0 else len(page)


def attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """A tag's attributes, from the end of its name on, and the place after the tag.

    A quote opens a value only after an equals sign; elsewhere it is part of a name. A value whose quote is never closed
    ends with the tag, so that no text is lost to it. last: the last place of either quote in the page. Each place is read at most twice.
    """
    found: dict[str, str] = {}
    size = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= size:
            return found, size
        if page[at] == ">":
            return found, at + 1
        key = _KEY.match(page, at)
        at, value = key.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                if at < last[quote]:
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    end = page.find(">", at)
                    end = end if end >= 0 else size
                    value, at = page[at + 1 : end], end
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(key[0].lower(), value)


class _Open:
    """The elements that are open, and where each kind last is, so that no end tag looks through them all."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []  # inline elements keep their block's number
        self.places: dict[str, list[int]] = {}
        self.push("#root", 0)

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.places.setdefault("#block", []).append(len(self.stack))
        self.stack.append((tag, node))

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    @property
    def node(self) -> int:
        return self.stack[-1][1]

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.places["#block"].pop()


def parse(page: str) -> list[Node]:
    """Block elements of a page, parents first, with the text directly in each cut into blocks at its block children.

    Inline elements belong to the block around them. Character references are decoded once, white space becomes
    one space, blocks are trimmed and empty ones left out. Unclosed, stray and cut-off tags are taken as browsers take them.
    Time is in proportion to the page's length, whatever its markup.
    """
    nodes = [Node("#root", -1)]
    opened = _Open()
    run: list[str] = []
    place = 0
    linked = 0
    size = len(page)
    last = {quote: page.rfind(quote) for quote in "\"'"}

    def flush() -> None:
        nonlocal place, linked
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            run.clear()
            if text:
                node = nodes[opened.node]
                node.blocks.append((place, text))
                node.chars += len(text)
                node.links += min(linked, len(text))
                place += 1
        linked = 0

    def close_to(depth: int) -> None:
        if opened.last("#block") >= depth:
            flush()
        opened.cut(depth)

    def text_of(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if opened.places.get("a"):
                linked += len(text)

    at = 0
    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            text_of(page[at:])
            break
        text_of(page[at : m.start()])
        at = m.start()
        name = _TAG.match(page, at + 1)
        if name is None:
            if page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                text_of(page[at + 9 : end if end >= 0 else size])
                at = end + 3 if end >= 0 else size
            else:
                at = _skipped(page, at)
            continue
        tag = name[2].lower()
        at = name.end()
        if page[at : at + 1] == ">":
            given, at, empty = {}, at + 1, False
        else:
            given, at = attributes(page, at, last)
            empty = page[at - 2] == "/"
        if name[1]:
            depth = opened.last(tag)
            if tag == "br":
                run.append(" ")
            elif tag == "p" and depth < 0:
                flush()
            elif depth > (opened.last("#block") if tag in INLINE else 0):  # an inline end tag doesn't close blocks
                close_to(depth)
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in _ENDS_P and opened.stack[opened.last("#block")][0] == "p":
            close_to(opened.last("#block"))
        if tag in _ENDS_OWN:
            depth = opened.last(*_ALIKE.get(tag, (tag,)))
            if depth > opened.last(*_ENDS_OWN[tag]):
                close_to(depth)
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            body = page[at : end.start()] if end else page[at:]
            at = end.end() if end else size
            flush()
            nodes[opened.node].children += 1
            nodes.append(Node(tag, opened.node, hidden=True))
            nodes[-1].chars = len(body) if tag != "title" else 0
            continue
        hidden = bool(given) and _hidden(given)
        if tag in INLINE:
            if tag == "a":
                nodes[opened.node].n_links += 1
            if not hidden:
                opened.push(tag, opened.node)
                continue
        flush()
        nodes[opened.node].children += 1
        nodes.append(Node(tag, opened.node, _names(given) if given else "", hidden or tag in DROPPED))
        if not empty or tag not in ("svg", "canvas", "object"):
            opened.push(tag, len(nodes) - 1)
    flush()
    return nodes


def _names(given: dict[str, str]) -> str:
    names = " ".join(given.get(k, "") for k in ("class", "id", "role", "itemprop"))
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", names)
    return re.sub(r"[^a-z]+", " ", names.lower()).strip()


def _hidden(given: dict[str, str]) -> bool:
    style = given.get("style", "").replace(" ", "").lower()
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


# ---- features

_TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "blockquote", "pre", "figure", "figcaption", "address", "dialog", "body")
#: Words in class, id, role or itemprop, by what they speak of.
_CUES = (
    ("article content main post entry story body text prose article body".split(), "content"),
    ("nav navbar menu menubar navigation breadcrumb breadcrumbs topbar tabs pagination pager toc skip".split(), "nav"),
    ("ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp adsense outbrain taboola".split(), "advert"),
    ("sidebar side aside widget rail related recommended recommendations trending popular more teaser".split(), "side"),
    ("comment comments disqus reply replies respond discussion".split(), "comment"),
    ("cookie cookies consent notice gdpr modal popup overlay alert dialog toast newsletter subscribe signup paywall".split(), "notice"),
    ("footer foot copyright legal colophon bottom".split(), "footer"),
    ("header masthead head top logo branding".split(), "header"),
    ("form search login contact field input".split(), "form"),
    ("share social sharing follow meta byline author tags tag categories date timestamp print".split(), "share"),
)
_TAG_CUES = {"nav": (1,), "aside": (3,), "footer": (6,), "form": (8,), "article": (0,), "main": (0,), "dialog": (5,)}
_N = len(_TAGS) + 2 * len(_CUES) + 14


@cache
def _cue_bits(names: str) -> tuple[int, ...]:
    words = set(names.split())
    return tuple(i for i, (cues, _) in enumerate(_CUES) if words & set(cues))


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node, from itself, its subtree and the cues of those around it."""
    n = len(nodes)
    chars, links, n_links, size = [0] * n, [0] * n, [0] * n, [1] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if not node.hidden:
            chars[i] += node.chars
            links[i] += node.links
            n_links[i] += node.n_links
        if node.parent >= 0:
            chars[node.parent] += chars[i]
            links[node.parent] += links[i]
            n_links[node.parent] += n_links[i]
            size[node.parent] += size[i]
    x = np.zeros((n, _N), np.float64)
    nearest: list[tuple[int, ...]] = [()] * n  # the cues of the closest element that has any, itself included
    t, c = len(_TAGS), len(_CUES)
    place = {tag: i for i, tag in enumerate(_TAGS)}
    whole = max(chars[0], 1)
    for i, node in enumerate(nodes):
        row = x[i]
        if node.tag in place:
            row[place[node.tag]] = 1
        own = _cue_bits(node.names) if node.names else ()
        for k in own:
            row[t + k] = 1
        above = nearest[node.parent] if node.parent >= 0 else ()
        cues = own + _TAG_CUES.get(node.tag, (7,) if node.tag == "header" and 0 not in above else ())
        nearest[i] = (tuple(q for q in cues if q) or cues) if cues else above  # what isn't content tells more
        for q in nearest[i]:
            row[t + c + q] = 1
        k = t + 2 * c
        density = links[i] / chars[i] if chars[i] else 0.0
        average = chars[i] / size[i]
        row[k] = density
        row[k + 1] = density > 0.6
        row[k + 2] = min(np.log1p(chars[i]) / 6, 2)
        row[k + 3] = min(np.log1p(average) / 5, 2)
        row[k + 4] = chars[i] / whole
        row[k + 5] = i / n
        row[k + 6] = node.chars > 80
        row[k + 7] = 0 < node.chars <= 80
        row[k + 8] = n_links[i] > 2 and average < 40
        row[k + 9] = node.hidden
        row[k + 10] = bool(node.blocks) and node.blocks[-1][1][-1:] in ".!?"
        row[k + 11] = node.tag == "header" and 0 in above
        row[k + 12] = chars[i] == 0
        row[k + 13] = 1
    return x


# ---- model


@dataclass
class TreeModel:
    """weights of content against boilerplate; pair[a, b] for a parent labelled a and its child labelled b."""

    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, nodes: list[Node]) -> list[float]:
        unary = features(nodes) @ self.weights
        return _sum_product([n.parent for n in nodes], unary, self.pair)[0]


def _sum_product(parents: list[int], unary: np.ndarray, pair: np.ndarray) -> tuple[list[float], np.ndarray]:
    """P(content) of each node, and the expected counts of parent and child labels. Parents come before children."""
    n = len(parents)
    p00, p01, p10, p11 = np.exp(pair - pair.max()).ravel().tolist()
    one = (1 / (1 + np.exp(-np.clip(unary, -30, 30)))).tolist()
    b0, b1 = [1 - g for g in one], list(one)  # belief from below
    up0, up1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):
        m0, m1 = p00 * b0[i] + p01 * b1[i], p10 * b0[i] + p11 * b1[i]
        s = m0 + m1
        up0[i], up1[i] = m0 / s, m1 / s
        j = parents[i]
        x, y = b0[j] * up0[i], b1[j] * up1[i]
        s = x + y or 1.0
        b0[j], b1[j] = x / s, y / s
    t00 = t01 = t10 = t11 = 0.0
    f0, f1 = list(b0), list(b1)  # with the message from above
    for i in range(1, n):
        j = parents[i]
        a0, a1 = f0[j] / (up0[i] or 1e-300), f1[j] / (up1[i] or 1e-300)  # the parent without this child
        s = a0 + a1 or 1.0
        a0, a1 = a0 / s, a1 / s
        c00, c01, c10, c11 = a0 * p00 * b0[i], a0 * p01 * b1[i], a1 * p10 * b0[i], a1 * p11 * b1[i]
        s = c00 + c01 + c10 + c11 or 1.0
        t00, t01, t10, t11 = t00 + c00 / s, t01 + c01 / s, t10 + c10 / s, t11 + c11 / s
        f0[i], f1[i] = (c00 + c10) / s, (c01 + c11) / s
    return f1, np.array([t00, t01, t10, t11])


def fit(pages: list[tuple[list[Node], list[int]]]) -> TreeModel:
    """Maximum likelihood on pages whose nodes are labelled, by gradient steps on all of them in turn."""
    data = [(features(nodes), [n.parent for n in nodes], np.array(labels, float)) for nodes, labels in pages]
    theta = np.zeros(_N + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    batch = 25
    for step in range(1, STEPS + 1):
        grad, count = np.zeros_like(theta), 0
        pair = theta[_N:].reshape(2, 2)
        for x, parents, y in (data[(step * batch + k) % len(data)] for k in range(batch)):
            good, both = _sum_product(parents, x @ theta[:_N], pair)
            grad[:_N] += x.T @ (y - np.array(good))
            a, b = y[parents[1:]] > 0.5, y[1:] > 0.5
            grad[_N:] += np.array([(~a & ~b).sum(), (~a & b).sum(), (a & ~b).sum(), (a & b).sum()]) - both
            count += len(y)
        grad = grad / count - DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return TreeModel(theta[:_N], theta[_N:].reshape(2, 2))


@cache
def trained(pages: int = PAGES) -> TreeModel:
    """The model fitted on so many composed pages; the same on every run."""
    made = []
    for seed in range(pages):
        page, labels = Composer(seed).page()
        nodes = parse(page)
        if len(nodes) == len(labels):  # a dropped end tag may have moved what follows it
            made.append((nodes, labels))
    return fit(made)


def main_text(page: str | None, model: TreeModel) -> str:
    """Blocks of content nodes in page order, joined by line feeds. Null and empty pages: empty."""
    if not page:
        return ""
    nodes = parse(page)
    good = model.marginals(nodes)
    hidden = [False] * len(nodes)
    kept = []
    for i, node in enumerate(nodes):
        hidden[i] = node.hidden or (node.parent >= 0 and hidden[node.parent])
        if not hidden[i] and good[i] >= 0.5:
            kept += node.blocks
    return "\n".join(text for _, text in sorted(kept))


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Nulls: a null page has an empty text; null ids and urls are kept. Repeated rows each get a row. An empty table gives
    no rows; other columns are ignored.
    """

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, model) for p in pages], dtype=object)

    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
