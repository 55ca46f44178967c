"""Main text of web pages by a minimum cut.

A page is read once into blocks: runs of text between block-level tags, each with its open elements and its share of link
text. Nodes of the graph are the blocks and the elements that hold them.

Terminal capacities of a block are the log-odds of a classifier that looks at the block alone (link density, length, end of
sentence, tag): what it costs to call it boilerplate, or content. Those of an element come from its tag, class and id names.
Edges: neighbours in page order, and each node and the element around it, the closer the stronger. An edge into an element
marked as boilerplate costs more to cut by a node that would be content, one into an element marked as content more by a
node that would not; capacities of elements are by the blocks they hold. The maximum flow gives the cheapest labelling;
blocks on the source side are content. So it is the cut that carries what is known of containers, and of neighbours, to blocks.

Text: character references are decoded, white space inside a block becomes one space, ends are trimmed, blocks are joined
by one space in page order. Scripts, styles, comments of the markup, the head and hidden elements are never blocks.

Defined results: null and empty html give "". Unclosed elements end with their container, an unclosed comment or script
takes the rest, a tag cut off at the end is dropped. A page without tags is one block, and content. Repeated rows each get
their row; an empty table gives an empty result; extra columns are ignored. Long pages are read whole.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm.common import batches_of, prepare, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""", re.DOTALL)
RAW = {x: re.compile(rf"</{x}\b[^>]*>?", re.IGNORECASE) for x in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "template", "noscript", "svg", "math", "object", "canvas", "video", "audio")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {"p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()), "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "option": frozenset(["option", "optgroup"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
WALLS = frozenset("html body table td th ul ol dl article section aside div nav form footer header main button select".split())
SKIPPED = frozenset(["head", "select", "datalist", "button"])
ATTR = re.compile(r"""(class|id|role|itemprop|aria-label|style|hidden|aria-hidden|rel)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|\Z)""", re.IGNORECASE)
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adslot|advertorial|banner|bread-?crumbs?|byline|captcha|cart|comment\w*|complementary|consent|contentinfo|cookie\w*|copyright|dialog|disclaimer|discussion|disqus|feedback|flash|foot\w*|gdpr|head|header|login|mast-?head|menu\w*|message-bar|meta|modal|nav\w*|newsletter|notice\w*|notification|outbrain|overlay|pager|pagination|paywall|pop-?up|popular|promo\w*|recommend\w*|register|related|repl(?:y|ies)|respond|responses?|reviews?|search|share|sharing|shop|sidebar|side-?bar|sign-?up|site-header|skip\w*|skyscraper|social|sponsor\w*|subscri\w*|taboola|tag-?cloud|tags|tool-?bar|tracking|trending|warning|alert|widget\w*)(?:$|[\s_-])",
    re.IGNORECASE,
)
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|hentry|main|post|story|text|prose|articlebody)(?:$|[\s_-])", re.IGNORECASE)
BAD_TAG = {"nav": 14.0, "footer": 14.0, "aside": 14.0, "form": 14.0, "menu": 12.0, "header": 9.0, "dialog": 14.0, "search": 12.0, "fieldset": 10.0, "label": 6.0, "address": 4.0}
GOOD_TAG = {"article": 7.0, "main": 5.0}
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE)
HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
SCALE = 100
SMOOTH, BESIDE, APART = 1.0, 1.0, 0.2  # log-odds of an edge to the element around, to the next block of the same place, of another
#: Log-odds of content by what features() sees of a block alone: a guess, and what fit_costs() makes of it on 500 pages of the
#: test tables, with blocks labelled by the elements that name their place.
PRIOR = (-0.5, -5.0, 0.9, 0.9, 0.7, 1.0)
COSTS = (-0.58, -5.01, 0.82, 0.97, 0.49, 1.26)


@dataclass
class Element:
    tag: str
    parent: Element | None
    names: str = ""
    hidden: bool = False
    number: int = 0
    depth: int = 0
    # What the tags and names from the page down to this element add up to; kept here, so that depth costs a block nothing.
    base: float = 0.0
    good: float = 0.0
    in_article: bool = False
    heading: bool = False
    own: float = 0.0  # what its own tag and names say, in log-odds
    holds: bool = False  # whether it is a node of the graph: not the page, html or body

    def __post_init__(self) -> None:
        up = self.parent
        if up is None:
            return
        self.base, self.good, self.in_article, self.heading = up.base, up.good, up.in_article or self.tag in GOOD_TAG, up.heading or self.tag in HEADING
        self.good = max(self.good, GOOD_TAG.get(self.tag, 0.0))
        self.base -= 2.0 if self.tag == "header" and self.in_article else BAD_TAG.get(self.tag, 0.0)
        if self.names and self.tag not in ("html", "body"):
            if BAD_NAME.search(self.names):
                self.base -= 12.0
            elif GOOD_NAME.search(self.names):
                self.good = max(self.good, 4.0)
        self.own, self.holds = self.base - up.base + self.good - up.good, self.tag not in ("html", "body")


@dataclass
class Block:
    text: str
    element: Element
    link_chars: int


def _element(tag: str, attrs: str, parent: Element, number: int) -> Element:
    names, hidden = "", False
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                names += f" {value}"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
                hidden = True
    return Element(tag, parent, re.sub(r"([a-z])([A-Z])", r"\1-\2", names), hidden or parent.hidden or tag in SKIPPED, number, parent.depth + 1)


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in page order."""
    out: list[Block] = []
    top = here = Element("#page", None)
    held: list[str] = []
    links, in_link, at, number = 0, 0, 0, 0

    def text(raw: str) -> None:
        nonlocal links
        if raw and not here.hidden:
            raw = unescape(raw) if "&" in raw else raw
            held.append(raw)
            if in_link:
                links += len(raw.strip())

    def flush() -> None:
        nonlocal links
        if held:
            joined = " ".join("".join(held).split())
            if joined:
                e = here
                while e.tag not in BLOCK and e.parent:
                    e = e.parent
                out.append(Block(joined, e, links))
            held.clear()
        links = 0

    while m := TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            e = here
            while e.parent and e.tag != tag:
                e = e.parent
            if e.parent:
                if tag in BLOCK:
                    flush()
                here = e.parent
                if tag == "a":
                    in_link = 0
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in BLOCK:
            flush()
        e = here
        while e.parent and e.tag not in WALLS:
            if tag in CLOSES.get(e.tag, ()):
                here = e.parent
            e = e.parent
        if e.tag in ("td", "th") and tag in CLOSES[e.tag]:
            here = e.parent
        attrs = m[3] or m[6] or ""
        if tag in RAW and not attrs.endswith("/"):
            end = RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID:
            continue
        if tag in ("body", "article", "main", "nav", "div", "p") and here.tag == "head":  # an unclosed head
            here = here.parent
        number += 1
        here = _element(tag, attrs, here, number)
        if tag == "a":
            in_link = 1
        elif tag in BLOCK:
            in_link = 0
    text(html[at:])
    flush()
    assert top.parent is None
    return out


def features(b: Block) -> tuple[float, ...]:
    """What the classifier sees of a block alone: one, link density, steps of length, end of a sentence, tag of running text."""
    n = len(b.text)
    density = min(1.0, b.link_chars / n)
    steps = 0.5 * (n >= 30) + (n >= 80) + (n >= 200)
    return 1.0, density * (1.0 if n < 400 else 0.5), steps, float(b.element.heading), float(n >= 20 and b.text[-1] in ".!?…\"”»"), float(b.element.tag in ("p", "blockquote", "pre", "#page"))


def log_odds(b: Block, costs: tuple[float, ...] = COSTS) -> float:
    """The classifier's log-odds of a block by itself: above zero for content."""
    return sum(w * x for w, x in zip(costs, features(b), strict=True)) - (6.0 if RIGHTS.match(b.text) else 0.0)


def min_cut(scores: list[float], edges: list[tuple[int, int, float, float]]) -> list[bool]:
    """For each node whether it is on the source (content) side of a minimum cut.

    scores: above zero, the capacity from the source; below, minus that to the sink. edges: (a, b, capacity from a to b, and
    back): what it costs if only a, or only b, is content. The flow is by Dinic's method, in whole hundredths.
    """
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, c: int, back: int) -> None:
        adj[a].append(len(to))
        to.append(b)
        cap.append(c)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for v, s in enumerate(scores):
        c = round(abs(s) * SCALE)
        if c:
            link(*((source, v) if s > 0 else (v, sink)), c, 0)
    for a, b, one, other in edges:
        link(a, b, round(one * SCALE), round(other * SCALE))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for k in adj[v]:
                if cap[k] and level[to[k]] < 0:
                    level[to[k]] = level[v] + 1
                    queue.append(to[k])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:  # blocking flow, without recursion
            if v == sink:
                flow = min(cap[k] for k in path)
                for k in path:
                    cap[k] -= flow
                    cap[k ^ 1] += flow
                cut = next(i for i, k in enumerate(path) if not cap[k])
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[v] < len(adj[v]):
                k = adj[v][nxt[v]]
                if cap[k] and level[to[k]] == level[v] + 1:
                    break
                nxt[v] += 1
            else:
                if v == source:
                    break
                k = path.pop()
                v = to[k ^ 1]
                nxt[v] += 1
                continue
            path.append(k)
            v = to[k]


def graph(blocks: list[Block]) -> tuple[list[float], list[tuple[int, int, float, float]]]:
    """Terminal scores of the page's nodes, blocks first, and its edges."""
    around: dict[int, Element] = {}
    held: dict[int, int] = {}  # blocks in each element
    for b in blocks:
        e = b.element
        if e.holds:
            held[e.number] = held.get(e.number, 0) + 1
        while e.holds and e.number not in around:
            around[e.number] = e
            e = e.parent
    for k in sorted(around, reverse=True):  # an element's number is above its parent's
        up = around[k].parent
        if up.holds:
            held[up.number] = held.get(up.number, 0) + held[k]
    node = {k: len(blocks) + i for i, k in enumerate(around)}
    scores = [log_odds(b) for b in blocks] + [held[k] * e.own for k, e in around.items()]
    inside = lambda at, up, n: (at, node[up.number], n * (SMOOTH - up.base), n * (SMOOTH + up.good))
    edges = [inside(k, b.element, 1) for k, b in enumerate(blocks) if b.element.holds]
    edges += [inside(node[k], e.parent, held[k]) for k, e in around.items() if e.parent.holds]
    for k in range(1, len(blocks)):
        a, e = blocks[k - 1].element, blocks[k].element
        w = BESIDE if a is e or (a.parent is e.parent and e.parent is not None and e.parent.holds) else APART
        edges.append((k - 1, k, w, w))
    return scores, edges


def content_blocks(blocks: list[Block]) -> list[bool]:
    return min_cut(*graph(blocks))[: len(blocks)]


def fit_costs(pages: list[str], ridge: float = 20.0, start: tuple[float, ...] = PRIOR) -> tuple[float, ...]:
    """COSTS by logistic regression (Newton steps, ridge towards start) on blocks that their place names: in an article and in nothing else, or in something marked as boilerplate."""
    x, y = [], []
    for b in (b for page in pages for b in blocks_of(page)):
        if b.element.in_article and not b.element.base or b.element.base and not b.element.in_article:
            x.append(features(b))
            y.append(float(b.element.in_article))
    a, t, prior = np.array(x), np.array(y), np.array(start)
    w = prior.copy()
    weight = np.where(t > 0, 0.5 / max(t.sum(), 1), 0.5 / max((1 - t).sum(), 1)) * 100  # both kinds count the same
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (weight * (p - t)) + ridge * (w - prior))
    return tuple(np.round(w, 2).tolist())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = blocks_of(html)
    return " ".join(b.text for b, keep in zip(blocks, content_blocks(blocks), strict=True) if keep)


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows():
        for b in batches:
            for page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = main_text(html.as_py())
                yield page, url, text, len(text)

    yield from batches_of(schema, rows(), 500)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    prepare(pages.sparkSession)
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    return base.mapInArrow(_extracting, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
