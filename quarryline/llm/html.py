"""Main text of web pages by gradient-boosted trees over DOM-node features.

A page is read into a tree of elements. Each element gets features: subtree text and link density,
attribute tokens of its own and its ancestors, depth, tag, sibling statistics. Boosted trees
give the probability that an element belongs to the main text, and a dynamic programme over the tree
decodes: an element is outside, inside or dropped, and on every path from the root the state may
only go in that order, so nothing is kept below dropped elements and no ancestor contradicts a descendant.

The trees are fitted on a bounded hash sample of those pages that mark a main element, whose elements are labelled by
their markup, on variants of them in which the main element's own markup is exchanged for a neutral one and boilerplate
of other kinds is put in, and on made-up pages of several layouts. Each tree is learnt from twice: as it is, and with all
names and telling tags taken away while the labels stay, so that the model doesn't lean on names or on one template.

Null and empty pages give an empty text, repeated rows equal ones, ties of the decoding go to
the outer state; an empty table gives an empty result; columns other than page_id, url and html are never read. Scripts, styles, forms and the like are never text."""

from __future__ import annotations

import html as references
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches
from .language import hash_sample

#: Pages and, in the order of their hash, characters that are fitted on.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 20_000_000
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([A-Za-z][\w:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|[^<]+|<", re.S | re.I)
ATTRS = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "small", "sub", "sup", "code", "q", "cite", "mark", "abbr", "font", "time", "kbd", "var", "samp", "del", "ins", "label", "bdi", "bdo", "big", "tt", "dfn", "data", "br", "wbr", "img"}
CLOSES_P = {"p", "div", "article", "section", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "aside", "main", "form", "pre", "blockquote", "figure", "hr", "address", "fieldset"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER = {"head", "form", "button", "select", "option", "input", "dialog", "object", "canvas", "audio", "video"}
GOOD = {"article", "content", "post", "entry", "main", "story", "body", "text", "articlebody", "blog"}
BAD = {"nav", "menu", "header", "footer", "sidebar", "side", "aside", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "notice", "newsletter", "subscribe", "signup", "popup", "modal", "comment", "comments", "reply", "replies", "discussion", "share", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "widget", "login", "search", "pagination", "copyright", "disclaimer", "toolbar", "navbar", "navigation", "complementary", "contentinfo", "gdpr", "alert", "tags", "meta"}
TELLING = {"article", "main", "nav", "menu", "header", "footer", "aside", "section"}
GROUPS = [{"article", "main"}, {"section"}, {"div"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dt", "dd"}, {"nav", "menu"}, {"header", "footer"}, {"aside"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"body", "html"}]


class Node:
    __slots__ = ("tag", "up", "kids", "tokens", "depth", "order", "chars", "linked", "tags", "good", "bad")

    def __init__(self, tag: str, up: Node | None, tokens: frozenset):
        self.tag, self.up, self.tokens, self.kids = tag, up, tokens, []
        self.depth = up.depth + 1 if up else 0
        self.good = bool(tokens & GOOD) or tag in GROUPS[0] or bool(up and up.good)
        self.bad = bool(tokens & BAD) or tag in {"nav", "menu", "header", "footer", "aside"} or tag in NEVER or bool(up and up.bad)


def tokens_of(attrs: str) -> frozenset:
    if "=" not in attrs:
        return frozenset()
    found = " ".join(a or b or c for a, b, c in ATTRS.findall(attrs))
    return frozenset(t.lower() for t in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", found) if t)


def parse(page: str) -> Node:
    """The tree of block elements; inline elements only leave their text (and their links' length)."""
    root = Node("html", None, frozenset())
    here, links = root, 0
    for m in PIECE.finditer(page):
        tag = m.group(3)
        if tag is None:
            text = m.group()
            if m.group(1) or text[:2] in ("<!", "<?"):
                continue
            here.kids.append((text, bool(links)))
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m.group(2) else 1
        if tag in INLINE:
            if tag in ("br", "img"):
                here.kids.append((" ", False))
            continue
        if m.group(2):
            at = here
            while at is not None and at.tag != tag:
                at = at.up
            if at is not None and at.up is not None:
                here, links = at.up, 0
            continue
        if tag in ("html",):
            continue
        close = {"p"} if tag in CLOSES_P else SAME.get(tag, set())
        at = here
        while at.up is not None and close and at.tag not in close and at.tag not in ("div", "td", "table", "ul", "ol", "article", "section", "main", "body", "aside", "nav"):
            at = at.up
        if at.tag in close and at.up is not None:
            here = at.up
        node = Node(tag, here, tokens_of(m.group(4)))
        here.kids.append(node)
        if tag not in VOID and not m.group(4).endswith("/"):
            here, links = node, 0
    return root


def nodes_of(root: Node) -> list[Node]:
    """All elements, parents first; sums up their subtrees."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.order = len(out)
        out.append(node)
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    for node in reversed(out):
        node.chars = node.linked = 0
        node.tags = 1
        for k in node.kids:
            if isinstance(k, Node):
                node.chars, node.linked, node.tags = node.chars + k.chars, node.linked + k.linked, node.tags + k.tags
            else:
                n = len(k[0].strip())
                node.chars += n
                node.linked += n * k[1]
    return out


def features(nodes: list[Node]) -> np.ndarray:
    total = nodes[0].chars or 1
    # of each element: how many siblings it has, how many of its kind, its place among them, the longest one
    beside: dict[int, tuple] = {0: (1, 1, 0, nodes[0].chars)}
    for up in nodes:
        kids = [k for k in up.kids if isinstance(k, Node)]
        tags, most = Counter(k.tag for k in kids), max((k.chars for k in kids), default=0)
        for i, k in enumerate(kids):
            beside[k.order] = (len(kids), tags[k.tag], i, most)
    out = []
    for x in nodes:
        peers, same, place, most = beside[x.order]
        out.append(
            [
                x.depth, math.log1p(x.chars), x.chars / x.tags, x.linked / (x.chars or 1), x.chars / total, peers, same, place / peers,
                most / (x.up.chars or 1) if x.up else 1.0, bool(x.tokens & GOOD), bool(x.tokens & BAD), bool(x.up and x.up.good), bool(x.up and x.up.bad), x.good, x.bad,
                sum(isinstance(k, Node) and k.tag in ("p", "blockquote") for k in x.kids), sum(not isinstance(k, Node) and len(k[0]) > 40 for k in x.kids), x.up.chars / total if x.up else 1.0,
                *[x.tag in g for g in GROUPS],
            ]
        )
    return np.array(out, np.float32)


class Trees:
    """Gradient-boosted regression trees for a binary outcome (logistic loss, quantile cuts)."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, cuts: int = 12, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.cuts, self.ridge = rounds, depth, rate, cuts, ridge
        self.trees: list[tuple] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.cuts))[:-1]) for c in x.T]
        p = (weight * y).sum() / weight.sum()
        self.start = math.log(max(p, 1e-6) / max(1 - p, 1e-6))
        f = np.full(len(x), self.start)
        tests = [(j, e, x[:, j] > e) for j, own in enumerate(edges) for e in own]
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = weight * (y - q), weight * q * (1 - q)
            tree = self._grow(x, g, h, tests, np.ones(len(x), bool), self.depth)
            self.trees.append(tree)
            f = f + self._apply(tree, x)
        return self

    def _grow(self, x, g, h, tests, here, depth):
        gs, hs = g[here].sum(), h[here].sum()
        leaf = (self.rate * gs / (hs + self.ridge),)
        if not depth or hs < 1e-3:
            return leaf
        best, found = 1e-3, None
        for j, e, right in tests:
            r = here & right
            gr, hr = g[r].sum(), h[r].sum()
            gain = gr * gr / (hr + self.ridge) + (gs - gr) ** 2 / (hs - hr + self.ridge) - gs * gs / (hs + self.ridge)
            if gain > best:
                best, found = gain, (j, e, right)
        if found is None:
            return leaf
        j, e, right = found
        return j, e, self._grow(x, g, h, tests, here & ~right, depth - 1), self._grow(x, g, h, tests, here & right, depth - 1)

    def _apply(self, tree, x) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        right = x[:, tree[0]] > tree[1]
        out = np.empty(len(x))
        out[right], out[~right] = self._apply(tree[3], x[right]), self._apply(tree[2], x[~right])
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._apply(t, x) for t in self.trees)


def decode(nodes: list[Node], margin: np.ndarray) -> list[int]:
    """States (0 outside, 1 inside, 2 dropped), only rising along a path, of the best total."""
    gain = [(-m, m, -m) if n.tag not in NEVER else (0.0, -1e6, 0.0) for n, m in zip(nodes, np.clip(margin, -8, 8).tolist(), strict=True)]
    best: list[list[float]] = [[0.0] * 3 for _ in nodes]
    for n in reversed(nodes):
        kids = [best[k.order] for k in n.kids if isinstance(k, Node)]
        for s in range(3):
            best[n.order][s] = gain[n.order][s] + sum(max(b[s:]) for b in kids)
    state = [0] * len(nodes)
    for n in nodes:
        low = state[n.up.order] if n.up else 0
        state[n.order] = max(range(low, 3), key=lambda s: best[n.order][s])
    return state


def text_of(nodes: list[Node], state: list[int]) -> str:
    """Blocks in page order."""
    out: list[str] = []
    part: list[str] = []

    def flush():
        s = " ".join(references.unescape("".join(part)).split())
        if s:
            out.append(s)
        part.clear()

    todo: list = [nodes[0]]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, tuple):
            part.append(x[1])
        else:
            flush()
            todo.append(None)
            for k in reversed(x.kids):
                if isinstance(k, Node):
                    todo.append(k)
                elif state[x.order] == 1:
                    todo.append((0, k[0]))
    return "\n".join(out)


def variants(page: str, rng: random.Random) -> list[str]:
    """Training pages: the page, and one with neutral main markup and more boilerplate, in random places."""
    fill = lambda n: " ".join(rng.choice(("lorem ipsum", "dolor", "sit amet", "elit", "sed do", "tempor")) for _ in range(n))
    junk = [
        lambda: f'<div class="{rng.choice(("sidebar", "related", "widget", "promo"))}"><h3>{fill(2)}</h3><ul>' + "".join(f'<li><a href="/">{fill(3)}</a></li>' for _ in range(rng.randint(2, 6))) + "</ul></div>",
        lambda: f'<{(t := rng.choice(("div", "section")))} id="{rng.choice(("comments", "discussion"))}">' + "".join(f'<div class="comment"><p>{fill(rng.randint(5, 60))}</p></div>' for _ in range(rng.randint(1, 4))) + f"</{t}>",
        lambda: f'<div class="{rng.choice(("cookie-notice", "consent", "newsletter", "banner"))}"><p>{fill(rng.randint(5, 20))}</p></div>',
        lambda: f"<aside><p>{fill(rng.randint(5, 40))}</p></aside>",
        lambda: f"<header><a href='/'>{fill(2)}</a> {fill(4)}</header>",
    ]
    start, end = re.search(r"<article[^>]*>", page), page.rfind("</article>")
    if not start or end < 0:
        return [page]
    body = page[start.end() : end]
    name = rng.choice(('div class="content"', 'div id="main"', 'div class="post-body"', "div", "section", "main", 'div class="x1"'))
    inner = body + rng.choice(junk)() if rng.random() < 0.4 else body
    new = page[: start.start()] + rng.choice(junk)() + f"<{name} data-main>" + inner + f"</{name.split()[0]}>" + rng.choice(junk)() + page[end + 10 :]
    return [page, new]


def made_up(rng: random.Random, n: int = 120) -> list[str]:
    """Pages of several layouts with a marked main element, menus, notices, sidebars and comments."""
    say = lambda k: " ".join("".join(rng.choice("aeinorstlu") for _ in range(rng.randint(2, 9))) for _ in range(k))
    link = lambda k: f'<a href="/">{say(k)}</a>'
    some = lambda make, low, high: "".join(make() for _ in range(rng.randint(low, high)))
    maybe = lambda make, chance: make() if rng.random() < chance else ""
    items = lambda low, high: "<ul>" + some(lambda: f"<li>{link(rng.randint(1, 4))}</li>", low, high) + "</ul>"
    spans = lambda low, high: some(lambda: f"<span>{link(rng.randint(1, 3))}</span>", low, high)
    block = [lambda: f"<p>{say(rng.randint(10, 120))}</p>", lambda: f"<p>{say(rng.randint(10, 60))} {link(2)} {say(rng.randint(3, 20))}</p>", lambda: f"<h2>{say(4)}</h2>", lambda: "<ul>" + some(lambda: f"<li>{say(rng.randint(4, 20))}</li>", 2, 5) + "</ul>", lambda: f"<blockquote>{say(20)}</blockquote>"]
    menu = lambda: rng.choice((f"<nav>{items(3, 9)}</nav>", f'<div class="menu">{items(4, 8)}</div>', f'<div id="header">{link(2)}{items(3, 5)}</div>', f'<header><div>{link(2)}</div><div>{spans(3, 7)}</div></header>', f'<table class="menu"><tr><td>{spans(4, 6)}</td></tr></table>'))
    notice = lambda: rng.choice((f'<div class="cookie">{say(rng.randint(6, 25))} {link(1)}</div>', f'<div class="notice"><p>{say(rng.randint(6, 25))}</p><a href="/">{say(1)}</a></div>', f'<section class="newsletter"><h3>{say(3)}</h3><p>{say(rng.randint(5, 15))}</p></section>'))
    side = lambda: rng.choice((f"<aside><h3>{say(2)}</h3>{items(3, 7)}</aside>", f'<div class="sidebar"><p>{say(rng.randint(5, 30))}</p>{items(2, 5)}</div>', f'<div class="related">{some(lambda: f"<div><b>{link(4)}</b><p>{say(rng.randint(4, 12))}</p></div>", 2, 4)}</div>'))
    voice = [lambda: f"<li><b>{say(1)}</b> {say(rng.randint(5, 40))}</li>", lambda: f"<div><p>{say(rng.randint(5, 50))}</p><small>{say(2)}</small></div>", lambda: f"<p><i>{say(2)}</i>: {say(rng.randint(4, 30))}</p>", lambda: f"<div><span>{say(1)}</span><time>{say(1)}</time><p>{say(rng.randint(5, 40))}</p><p>{say(rng.randint(5, 30))}</p></div>"]
    comments = lambda: (lambda one: f'<div class="comments"><h3>{say(2)}</h3>{some(one, 2, 6)}</div>')(rng.choice(voice))
    foot = lambda: rng.choice((f"<footer><p>{say(8)}</p></footer>", f'<div class="footer">{say(6)} {link(2)}</div>', f'<div class="footer">{items(3, 5)}<p>{say(5)}</p></div>'))
    out = []
    for _ in range(n):
        body = maybe(lambda: f"<h1>{say(rng.randint(3, 8))}</h1>", 0.9) + f"<p>{say(40)}</p>" + some(lambda: rng.choice((block[0], block[0], *block))(), 1, 9)
        main = f"<article>{body}</article>"
        inner, outer = maybe(comments, 0.3), maybe(comments, 0.4)
        row = [main + inner, maybe(side, 0.5)]
        rng.shuffle(row)
        middle = "".join(row)
        for _ in range(rng.randint(0, 3)):
            middle = f"<div>{middle}</div>"
        out.append(f"<html><head><title>{say(3)}</title></head><body>{maybe(notice, 0.4)}{menu()}{maybe(notice, 0.3)}{middle}{outer}{maybe(side, 0.2)}{foot()}{maybe(notice, 0.2)}</body></html>")
    return out


def labels(nodes: list[Node]) -> np.ndarray:
    """1 for elements of a marked main element that are not in boilerplate."""
    inside: list[bool] = []
    for n in nodes:
        up = inside[n.up.order] if n.up else False
        inside.append((up or n.tag in GROUPS[0] or "datamain" in n.tokens) and not (bool(n.tokens & BAD) or n.tag in {"nav", "header", "footer", "aside", "form"} and not n.tag == "header"))
    return np.array(inside, float)


def unnamed(nodes: list[Node]) -> list[Node]:
    """The same tree as a page without telling names would have: no classes, ids or roles, and plain blocks for all that says what it is."""
    for n in nodes:
        n.tokens = frozenset()
        if n.tag in TELLING:
            n.tag = "div"
        n.good, n.bad = False, n.tag in NEVER or bool(n.up and n.up.bad)
    return nodes


def train(pages: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Trees:
    """Fitted on a sample of about ``sample_rows`` pages that mark a main element, as far as they hold ``sample_chars`` characters."""
    picked = pages.select("page_id", F.col("html").cast("string").alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    order = [F.xxhash64("html"), "page_id", "html"]
    upto = F.sum(F.length("html")).over(Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # a row a sampled page
    sample = hash_sample(picked, sample_rows, "page_id").withColumn("_upto", upto).where(F.col("_upto") <= sample_chars)
    return fit(sorted(r[0] for r in sample.select("html").collect()))


def fit(sample: list[str]) -> Trees:
    rng = random.Random(11)
    xs, ys = [], []

    def learn(pages: list[str]) -> None:
        for page in pages:
            for v in variants(page, rng):
                root = parse(re.sub(r"<(\w+)([^<>]*) data-main>", r'<\1\2 itemprop="datamain">', v))
                nodes = nodes_of(root)
                y = labels(nodes)
                # what isn't marked is unknown, not negative
                if y.any():
                    xs.extend((features(nodes), features(unnamed(nodes))))
                    ys.extend((y, y))

    learn(sample)
    learn(made_up(rng))
    trees = Trees()
    if xs:
        x, y = np.vstack(xs), np.concatenate(ys)
        if 0 < y.mean() < 1:
            trees.fit(x, y, np.ones(len(y)))
    return trees


def extract(trees: Trees, page: str | None) -> str:
    if not page or not trees.trees:
        return ""
    nodes = nodes_of(parse(page))
    return text_of(nodes, decode(nodes, trees.margins(features(nodes))))


def main_text(pages: DataFrame, trees: Trees) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    spark = pages.sparkSession
    bound_batches(spark, 64)
    shared = spark.sparkContext.broadcast(trees)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches):
        for b in batches:
            docs = [nodes_of(parse(p)) if p else None for p in b.column(2).to_pylist()]
            feats = [features(d) for d in docs if d]
            margins = shared.value.margins(np.vstack(feats)) if feats and shared.value.trees else None
            out, at = [], 0
            for d in docs:
                if not d or margins is None:
                    out.append("")
                    continue
                out.append(text_of(d, decode(d, margins[at : at + len(d)])))
                at += len(d)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def extract_pages(pages: DataFrame) -> DataFrame:
    """The thin query."""
    return main_text(pages, train(pages))
