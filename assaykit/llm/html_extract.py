"""Main text of pages: boosted trees judge the nodes of the page tree, one consistent choice decodes them."""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# trees are fitted on at most this many pages, those with the smallest hashes, of at most this many nodes each
TRAIN_PAGES = 300
TRAIN_NODES = 400
NODES_AT_ONCE = 5000
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 40, 4, 0.25, 32, 8

# Elements of the markup language by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select button head".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2
    h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead
    tr ul""".split()
)
# an open paragraph, item or cell ends where one of these starts
CLOSES = {
    "p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
# Words in class, id, role and aria attributes, by what they usually mark.
MAIN_WORDS = frozenset("article main content post entry story body text prose".split())
ASIDE_WORDS = frozenset(
    """ad ads advert advertisement advertorial sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead
    footer foot copyright sidebar side aside rail widget related recommended popular trending share sharing social follow newsletter subscribe
    signup login search form cookie cookies consent gdpr notice alert popup modal overlay paywall comment comments reply replies disqus discussion
    respond pagination pager tags toolbar skip""".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies disqus discussion respond".split())

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)", re.DOTALL)
_STOP = re.compile(r"[>\"']")
# an attribute starts where no name runs on, so a long run of characters is looked at once
_ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """An element, or a run of text (tag ``#text``)."""

    tag: str
    parent: int
    depth: int
    words: frozenset[str] = frozenset()
    text: str = ""
    block: int = 0
    children: list[int] = field(default_factory=list)


@functools.cache
def _end_of(tag: str) -> re.Pattern[str]:
    """Where the text of an element of ``RAW`` ends; a head also ends where a body begins."""
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.IGNORECASE)


class _Open:
    """The open elements, with the places of each name, so that none is looked for by walking."""

    BARRIERS = frozenset(["table", "body", "article", "main"])

    def __init__(self) -> None:
        self.nodes = [0]
        self.tags = ["#root"]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.barriers: list[int] = []

    def push(self, node: int, tag: str) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in self.BARRIERS:
            self.barriers.append(at)

    def last(self, tag: str) -> int:
        """The innermost open element of a name, or 0."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def cut(self, at: int) -> int:
        """Close what is open from ``at`` on; returns how many of it are blocks."""
        closed = 0
        while len(self.nodes) > at:
            self.nodes.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                closed += 1
            if tag in self.BARRIERS:
                self.barriers.pop()
        return closed


def parse(page: str) -> list[Node]:
    """Nodes in page order; the first is the root. Unclosed and stray tags are taken as browsers do, roughly.

    Scripts, styles, heads and other elements that hold no running text are left out with all they hold. Each text run
    carries the number of its block: a new one begins at every start and end of a block element. Every search that fails
    is made once, so broken pages take time in proportion to their length: where a quote is never closed tags end at the next
    ">" from then on, and what follows the last ">" is text.
    """
    nodes = [Node("#root", -1, 0)]
    open_ = _Open()
    block, at, n = 0, 0, len(page)
    quoted, endless = True, set()
    last_end = page.rfind(">")

    def add_text(raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        up = open_.nodes[-1]
        nodes[up].children.append(len(nodes))
        nodes.append(Node("#text", up, nodes[up].depth + 1, text=text, block=block))

    def tag_end(start: int) -> int:
        """Where the ">" of a tag is, passing over quoted values; -1 if a quote or the tag never ends."""
        while True:
            m = _STOP.search(page, start)
            if m is None:
                return -1
            if m.group() == ">":
                return m.start()
            start = page.find(m.group(), m.end()) + 1
            if not start:
                return -1

    text_from = 0
    while at < n:
        m = _MARK.search(page, at)
        if m is None:
            break
        raw_tag = m.group(2)
        if raw_tag is None:
            add_text(page[text_from : m.start()])
            at = text_from = m.end()
            if m.group().startswith("<![CDATA["):
                add_text(m.group()[9:].removesuffix("]]>"))
            continue
        if m.start() > last_end:
            break  # no tag ends any more
        end = tag_end(m.end()) if quoted else page.find(">", m.end())
        if end < 0 and quoted:
            quoted = False
            end = page.find(">", m.end())
        if end < 0:
            break
        add_text(page[text_from : m.start()])
        attrs = page[m.end() : end]
        at = text_from = end + 1
        tag = raw_tag.lower()
        if m.group(1):
            k = open_.last(tag)
            barrier = open_.barriers[-1] if open_.barriers else 0
            if k and (tag in BLOCK or barrier <= k):
                block += open_.cut(k)
            continue
        for name, starts in CLOSES.items():
            if tag in starts:
                k = open_.last(name)
                if k and open_.blocks and open_.blocks[-1] <= k:
                    block += open_.cut(k)
        if tag in RAW:
            found = _end_of(tag).search(page, at) if not attrs.endswith("/") and tag not in endless and at <= last_end else None
            if found:
                at = text_from = found.end()
            elif not attrs.endswith("/"):
                endless.add(tag)
                if tag in ("script", "style"):
                    at = text_from = n
            continue
        if tag == "br":
            add_text("\n")
            continue
        if tag in BLOCK:
            block += 1
        if tag in VOID:
            continue
        words: frozenset[str] = frozenset()
        if attrs and "=" in attrs:
            made = set()
            for a in _ATTRIBUTE.finditer(attrs):
                if a.group(1).lower() in ("class", "id", "role", "aria-label", "itemprop", "data-role", "data-type"):
                    value = a.group(2) or a.group(3) or a.group(4) or ""
                    made.update(w.lower() for w in _TOKEN.findall(value))
            words = frozenset(made)
        up = open_.nodes[-1]
        nodes[up].children.append(len(nodes))
        nodes.append(Node(tag, up, nodes[up].depth + 1, words))
        if not attrs.endswith("/") or tag in BLOCK:
            open_.push(len(nodes) - 1, tag)
    add_text(page[text_from:])
    return nodes


TAG_GROUPS = (
    frozenset(["article", "main"]), frozenset(["nav", "menu"]), frozenset(["header"]), frozenset(["footer"]), frozenset(["aside"]),
    frozenset(["form", "fieldset", "label", "dialog"]), frozenset(["p", "blockquote", "pre"]), frozenset(["ul", "ol", "dl"]), frozenset(["li", "dt", "dd"]),
    frozenset(["a"]), frozenset(["h1", "h2", "h3", "h4", "h5", "h6"]), frozenset(["table", "tbody", "thead", "tr", "td", "th"]), frozenset(["div", "section"]),
    frozenset(["#text"]), frozenset(["body", "html", "#root"]),
)
GROUP_OF = {tag: k for k, tags in enumerate(TAG_GROUPS) for tag in tags}
N_FEATURES = 3 * (len(TAG_GROUPS) + 1) + 20


def describe(nodes: list[Node]) -> np.ndarray:
    """One row of features for each node: its kind, its parent's and all ancestors', what it holds, and its siblings."""
    n, log = len(nodes), math.log1p
    size, links, paragraphs, elements, stops = ([0] * n for _ in range(5))
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        p = x.parent
        if x.tag == "#text":
            size[i] = len(x.text.strip())
            stops[i] = x.text.count(".") + x.text.count(",")
        elif x.tag == "a":
            links[i] = size[i]
        elif x.tag == "p":
            paragraphs[i] += 1
        if p >= 0:
            size[p] += size[i]
            links[p] += links[i]
            paragraphs[p] += paragraphs[i]
            stops[p] += stops[i]
            elements[p] += elements[i] + (x.tag != "#text")
    whole = size[0] or 1
    none = len(TAG_GROUPS)
    kind = [GROUP_OF.get(x.tag, none) for x in nodes]
    over, above, rank = [none] * n, [0] * n, [0] * n
    marks = [(bool(x.words & MAIN_WORDS), bool(x.words & ASIDE_WORDS), bool(x.words & COMMENT_WORDS)) if x.words else (False, False, False) for x in nodes]
    inherited = [(False, False, False)] * n
    rows = []
    for i, x in enumerate(nodes):
        p = x.parent
        for k, c in enumerate(x.children):
            rank[c] = k
        mates, around = 1, whole
        if p >= 0:
            over[i], above[i] = kind[p], above[p] | 1 << kind[p]
            (a, b, c), (d, e, f) = marks[p], inherited[p]
            inherited[i] = (a or d, b or e, c or f)
            mates, around = len(nodes[p].children), size[p] or 1
        own = size[i] or 1
        rows.append((
            x.depth, mates, rank[i] / mates, rank[i], size[i] / around, size[i] / whole, log(size[i]), links[i] / own, links[p] / around if p >= 0 else 0.0,
            log(paragraphs[i]), log(elements[i]), size[i] / (elements[i] + 1), 100 * stops[i] / own, len(x.children), *marks[i], *inherited[i],
        ))
    bits = np.arange(none + 1)
    return np.hstack([
        np.asarray(kind)[:, None] == bits, np.asarray(over)[:, None] == bits, (np.asarray(above)[:, None] >> bits) & 1, np.asarray(rows, np.float64)
    ])


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays: feature (-1 in leaves), cut, left and right child, value."""

    base: float
    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                go = x[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            out += value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient-boosted trees for two classes: histogram cuts, second-order leaves, the logistic loss."""
    if len(y) == 0 or y.min() == y.max():
        return Trees(4.0 if len(y) and y[0] else -4.0, ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.int64)
    wide = BINS + 1
    flat = codes + np.arange(x.shape[1]) * wide
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, left, right, value = [], [], [], [], []
        todo = [(np.arange(len(y)), 0, -1, False)]
        while todo:
            rows, depth, parent, is_right = todo.pop(0)
            me = len(feature)
            if parent >= 0:
                (right if is_right else left)[parent] = me
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            feature.append(-1), cut.append(0.0), left.append(0), right.append(0), value.append(RATE * sum_g / (sum_h + 1.0))
            if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
                where = flat[rows].ravel()
                k = x.shape[1]
                hist = [np.bincount(where, np.repeat(v, k), k * wide).reshape(k, wide).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows)))]
                lg, lh, ln = hist
                gain = lg**2 / (lh + 1) + (sum_g - lg) ** 2 / (sum_h - lh + 1) - sum_g**2 / (sum_h + 1)
                gain[(ln < LEAST_ROWS) | (len(rows) - ln < LEAST_ROWS)] = -1
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, b] > 1e-3 and b < len(edges[f]):
                    feature[me], cut[me] = int(f), float(edges[f][b])
                    go = codes[rows, f] <= b
                    todo += [(rows[go], depth + 1, me, False), (rows[~go], depth + 1, me, True)]
        tree = tuple(np.array(a) for a in (feature, cut, left, right, value))
        trees.append(tree)
        score += Trees(0.0, (tree,)).logit(x)
    return Trees(base, tuple(trees))


def choose(nodes: list[Node], logit: np.ndarray) -> list[bool]:
    """The most likely labels where a node is kept only if its parent is: no kept text below a dropped element.

    Bottom-up, a node is worth keeping if its own log odds and the best of its children together are positive.
    """
    gain = logit.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    keep = [True] * len(nodes)
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and gain[i] > 0
    return keep


def blocks(nodes: list[Node], keep: list[bool] | np.ndarray) -> list[str]:
    """Kept text by block, white space joined."""
    out, now, last = [], [], -1
    for i, x in enumerate(nodes):
        if x.tag == "#text" and keep[i]:
            if x.block != last and now:
                out.append("".join(now))
                now = []
            last = x.block
            now.append(x.text)
    if now:
        out.append("".join(now))
    joined = (" ".join(b.split()) for b in out)
    return [b for b in joined if b]


def extract(pages: Iterable[str | None], trees: Trees) -> Iterator[str]:
    """Main text of each page; the nodes of about ``NODES_AT_ONCE`` go through the trees together."""
    group: list[list[Node]] = []

    def judged() -> Iterator[str]:
        if not group:
            return
        score = np.clip(trees.logit(np.concatenate([describe(nodes) for nodes in group])), -12, 12)
        at = 0
        for nodes in group:
            yield "\n".join(blocks(nodes, choose(nodes, score[at : at + len(nodes)])))
            at += len(nodes)

    size = 0
    for page in pages:
        group.append(parse(page or ""))
        size += len(group[-1])
        if size >= NODES_AT_ONCE:
            yield from judged()
            group, size = [], 0
    yield from judged()


# --- training pages -----------------------------------------------------------------------------------------------
# Pages have no labels. Their own marked-up articles serve as examples: a page is rebuilt with its article in one of many
# usual containers, and with boilerplate of many kinds, made of its other texts, put around and into it.

# Shells of articles and of boilerplate. {} is where the text goes.
ARTICLE_SHELLS = (
    "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="post-content">{}</div>',
    '<div id="content"><div class="entry">{}</div></div>', '<section class="story-body">{}</section>', '<div role="main">{}</div>', "<div><article class='post'>{}</article></div>",
    '<div class="wrapper"><div class="article-text">{}</div></div>', "<div>{}</div>",
)
OUTER_SHELLS = (
    "<nav>{}</nav>", "<nav><ul><li><a href='/x'>{}</a></li><li><a href='/y'>{}</a></li></ul></nav>", '<div class="menu"><a href="/m">{}</a></div>', "<header>{}</header>",
    "<header><h2>{}</h2><p>{}</p></header>", '<div class="ad">{}</div>', '<div class="ads-banner"><p>{}</p></div>', '<div id="sidebar"><p>{}</p></div>', "<aside>{}</aside>",
    "<aside><h3>{}</h3><p>{}</p></aside>", '<div class="cookie-notice"><p>{}</p></div>', '<div class="alert notice">{}</div>', "<form><label>{}</label><p>{}</p></form>",
    '<form class="newsletter"><p>{}</p></form>', "<footer>{}</footer>", "<footer><p>{}</p><p>{}</p></footer>", '<div class="related"><ul><li><a href="/r">{}</a></li></ul></div>',
    '<section id="comments"><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>', '<div class="comments"><p>{}</p><p>{}</p></div>',
    '<ol class="comment-list"><li><p>{}</p></li></ol>', '<div class="share">{}</div>', '<div class="breadcrumbs"><a href="/">{}</a></div>', '<div class="sponsored">{}</div>',
)
INNER_SHELLS = (
    '<div class="ad">{}</div>', "<aside>{}</aside>", '<div class="share">{}</div>', '<div class="promo"><p>{}</p></div>', '<form><p>{}</p></form>',
    '<div class="related"><a href="/r">{}</a></div>', '<div class="newsletter">{}</div>', '<section class="comments"><p>{}</p></section>', '<nav>{}</nav>', '<footer>{}</footer>',
)
_MAIN = re.compile(r"<(article|main)\b[^>]*>(.*)</\1\s*>", re.DOTALL | re.IGNORECASE)
_OTHER = re.compile(r">([^<>]{12,})<")
GOOD, BAD = "\ue000", "\ue001"  # private-use marks that tell where a training text came from


def training_page(page: str, draw: np.random.Generator) -> tuple[str, bool]:
    """A page rebuilt around its article, texts marked by what they are; False if it has no article to learn from."""
    m = _MAIN.search(page)
    if m is None:
        return "", False
    inside, outside = m.group(2), page[: m.start()] + page[m.end() :]
    spare = [t for t in _OTHER.findall(re.sub(r"(?is)<(script|style|head)\b.*?</\1>", "", outside))] + _OTHER.findall(inside)[:3] or ["text of no note"]

    def fill(shell: str) -> str:
        return re.sub(r"\{\}", lambda _: BAD + spare[draw.integers(len(spare))], shell)

    inside = re.sub(r">([^<>]*[^\s<>][^<>]*)", lambda t: ">" + GOOD + t.group(1), ">" + inside)[1:]
    parts = re.split(r"(?=<p\b)", inside)
    for _ in range(int(draw.integers(0, 3))):
        parts.insert(int(draw.integers(1, len(parts) + 1)), fill(INNER_SHELLS[draw.integers(len(INNER_SHELLS))]))
    article = ARTICLE_SHELLS[draw.integers(len(ARTICLE_SHELLS))].replace("{}", "".join(parts))
    around = [fill(OUTER_SHELLS[draw.integers(len(OUTER_SHELLS))]) for _ in range(int(draw.integers(2, 7)))]
    cut = int(draw.integers(0, len(around) + 1))
    body = "".join(around[:cut]) + article + "".join(around[cut:])
    return f"<html><body>{body if draw.random() < 0.5 else '<div id=page>' + body + '</div>'}</body></html>", True


def training_rows(page: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of a rebuilt page: a node is wanted if any wanted text is below it."""
    draw = np.random.default_rng(seed)
    made, ok = training_page(page, draw)
    if not ok:
        return np.empty((0, N_FEATURES)), np.empty(0)
    nodes = parse(made)
    wanted = np.zeros(len(nodes), bool)
    known = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        if x.tag == "#text":
            wanted[i], known[i] = GOOD in x.text, GOOD in x.text or BAD in x.text
            x.text = x.text.replace(GOOD, "").replace(BAD, "")
    for i in range(len(nodes) - 1, 0, -1):
        wanted[nodes[i].parent] |= wanted[i]
        known[nodes[i].parent] |= known[i]
    at = np.flatnonzero(known)
    if len(at) > TRAIN_NODES:
        at = np.sort(draw.permutation(at)[:TRAIN_NODES])
    return describe(nodes)[at], wanted[at].astype(np.float64)


def train(pages: DataFrame, key: str = "page_id", page: str = "html", limit: int = TRAIN_PAGES) -> Trees:
    """Fit on rebuilt pages of a bounded sample; tasks describe the nodes, the driver grows the trees.

    Without any page that marks its article, a fixed example page is learned from.
    """
    sample = pages.filter(F.col(page).isNotNull()).select(F.xxhash64(key, page).alias("seed"), F.col(page).alias("page"))
    ids = sample.select("seed").distinct().orderBy("seed").limit(limit)
    # copies of a page count once, however many there are
    rows = sample.join(F.broadcast(ids), "seed").groupBy("seed").agg(F.min("page").alias("page"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed, text in zip(batch["seed"], batch["page"]):
                for k in range(3):
                    x, y = training_rows(text, (int(seed) + k) & 0xFFFFFFFF)
                    if len(y):
                        yield pd.DataFrame({"seed": [seed], "k": [k], "x": [x.astype(np.float32).ravel()], "y": [y.astype(np.float32)]})

    found = rows.mapInPandas(make, "seed long, k int, x array<float>, y array<float>").orderBy("seed", "k").toPandas()
    if found.empty:
        made = [training_rows(EXAMPLE, k) for k in range(60)]
    else:
        made = [(np.asarray(x, np.float64).reshape(-1, N_FEATURES), np.asarray(y, np.float64)) for x, y in zip(found["x"], found["y"])]
    return fit_trees(np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made]))


EXAMPLE = "<body><nav><a href='/'>Home of the site</a></nav><article><h1>A title of some words</h1><p>First of all, a long sentence.</p><p>Then another, longer sentence.</p></article><footer>All rights reserved, of course.</footer></body>"


def main_text(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: key, ``url`` if there is one, ``text`` and ``n_chars``.

    A null or empty page, and one without kept text, gives an empty text. Repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result.
    """
    trees = train(pages, key, page)

    @F.pandas_udf("string")
    def extracted(texts: pd.Series) -> pd.Series:
        return pd.Series(list(extract(texts, trees)), dtype=object)

    kept = [c for c in (key, "url") if c in pages.columns]
    return pages.select(*kept, extracted(F.col(page)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
