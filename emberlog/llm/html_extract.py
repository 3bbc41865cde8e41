"""HTML extraction: boosted trees over DOM nodes, decoded down the tree.

Every page is parsed in its task into nodes with features: tag, attribute
tokens, depth, siblings, text and link density of the subtree. Gradient-boosted
trees (trained by Spark ML on generated, labelled pages) give each node a
probability of being kept; the decoding picks the most probable choice in
which nothing below a dropped node is kept. The text of kept nodes is joined
block by block.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import table
from emberlog.llm.pages_for_training import pages

#: Generated pages that the classifier is fitted on, and those held out by the tests.
TRAIN_PAGES, SEED, TREES, DEPTH = 400, 7, 24, 5
#: Nodes of the pages that are judged together; a page with more is judged alone.
NODES_AT_ONCE = 50_000

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template noscript svg iframe object canvas textarea select".split())
#: What ends a comment right behind its start, and later.
COMMENT_AT_ONCE, COMMENT_END = re.compile("-?>"), re.compile("--!?>")
#: Start tags that end a select that was left open.
ENDS_SELECT = frozenset("select input textarea".split())
#: Start tags that end an svg that was left open.
BREAKOUT = frozenset("b blockquote body center code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img li ol p pre s small span strong sub sup table u ul".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr button".split())
#: Open elements that a start tag ends, as far up as the element that bounds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Groups of attribute tokens (word parts of class, id and role), by what they tell.
TOKENS = (
    frozenset("nav navbar navigation menu topnav breadcrumb breadcrumbs links".split()),
    frozenset("header masthead top branding banner logo".split()),
    frozenset("footer copyright colophon bottom".split()),
    frozenset("sidebar side aside related widget recommended recommendations popular rail complementary".split()),
    frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion adslot".split()),
    frozenset("cookie cookies notice consent alert gdpr popup modal overlay".split()),
    frozenset("comment comments reply replies discussion disqus respond".split()),
    frozenset("share social follow subscribe newsletter login search signup form".split()),
    frozenset("article content post entry story main text body".split()),
)
TAGS = "html head body title div section article main nav header footer aside form button label input ul ol li a p h1 h2 h3 span b table td blockquote pre".split()
TAG_NO = {t: i for i, t in enumerate(TAGS)}


class Page(HTMLParser):
    """One page as parallel lists of its elements, in document order."""

    def __init__(self, html: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.html, self.at = html, 0
        #: characters from the last end tag of a name to the end of the page; 0: none
        self.last_end: dict[str, int] = {}
        self.tag: list[str] = ["#page"]
        self.parent, self.depth, self.tokens, self.label = [-1], [0], [0], [-1]
        self.open = [0]
        self.silent: list[str] = []
        #: (element, text); text None: a block begins or ends here
        self.run: list[tuple[int, str | None]] = []

    def _close_to(self, at: int) -> None:
        for n in self.open[at:]:
            if self.tag[n] not in INLINE:
                self.run.append((n, None))
        del self.open[at:]

    def _find(self, tags: set[str] | frozenset[str], bound: set[str]) -> int:
        for at in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[at]]
            if t in tags:
                return at
            if t in bound:
                return 0
        return 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            svg = self.silent[0] == "svg" and not {"foreignobject", "desc", "title"} & set(self.silent)
            if svg and tag in BREAKOUT:
                self.silent.clear()
            elif self.silent[0] == "select" and tag in ENDS_SELECT:
                self.silent.clear()
                if tag == "select":
                    return
            if self.silent:
                if tag not in VOID:
                    self.silent.append(tag)
                return
        if tag in SILENT:
            if tag == "select" or self._ends_later(tag):  # a select that is left open ends with what is open around it
                self.silent.append(tag)
            return
        if tag == "br":
            self.run.append((self.open[-1], " "))
            return
        ends, bound = ENDS.get(tag, (set(), set()))
        if tag not in INLINE and tag not in VOID:
            ends, bound = ends | {"p"}, bound | {"table", "button", "td", "article", "section", "div", "body"}
        if ends and (at := self._find(ends, bound)):
            self._close_to(at)
        bits, label = 0, -1
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                for t in re.findall("[a-z]+", value.lower()):
                    for g, group in enumerate(TOKENS):
                        if t in group:
                            bits |= 1 << g
            elif name == "data-y":
                label = int(value == "1")
        up = self.open[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.tokens.append(bits)
        self.label.append(label)
        if tag not in INLINE:
            self.run.append((len(self.tag) - 1, None))
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)

    def _or_end(self, k: int) -> int:
        """Where markup ends; with the page, which is fed whole, if it is left open."""
        return k if k >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        self.at = len(self.rawdata) - i
        return self._or_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._or_end(super().parse_endtag(i))

    def parse_comment(self, i: int, report: bool = True) -> int:
        found = COMMENT_AT_ONCE.match(self.rawdata, i + 4) or COMMENT_END.search(self.rawdata, i + 4)
        return found.end() if found else len(self.rawdata)

    def parse_bogus_comment(self, i: int, report: int = 1) -> int:
        return self._or_end(super().parse_bogus_comment(i, report))

    def parse_html_declaration(self, i: int) -> int:
        return self._or_end(super().parse_html_declaration(i))

    def parse_pi(self, i: int) -> int:
        return self._or_end(super().parse_pi(i))

    def _ends_later(self, tag: str) -> bool:
        """Whether the page has an end tag of this name after the present start tag; an element without one is empty."""
        if tag not in self.last_end:
            ends = [m.start() for m in re.finditer(f"</{tag}", self.html, re.I)]
            self.last_end[tag] = len(self.html) - ends[-1] if ends else 0
        return 0 < self.last_end[tag] < self.at

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # <div/> is a start tag in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
                return
            if self.silent[0] == "template" or not self._find({tag}, set()):
                return
            self.silent.clear()  # the end of what is open around it
        if at := self._find({tag}, set()):
            self._close_to(at)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append((self.open[-1], data))


def parsed(html: str | None) -> Page:
    page = Page(html or "")
    page.feed(html or "")
    page.close()
    return page


def by_depth(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1)))


def features(batch: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of the pages, with parent (-1: none) and depth of each."""
    counts = np.array([len(p.tag) for p in batch])
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(batch, first, strict=True)])
    depth = np.concatenate([p.depth for p in batch])
    tokens = np.concatenate([p.tokens for p in batch])
    tag = np.array([TAG_NO.get(t, -1) for p in batch for t in p.tag])
    inline = np.array([t in INLINE for p in batch for t in p.tag])
    page_no = np.repeat(np.arange(len(batch)), counts)
    own = np.zeros((n, 5))  # characters, words, commas and stops, characters in links, nodes
    own[:, 4] = 1
    is_link = tag == TAG_NO["a"]
    at, chars, words, marks = [], [], [], []
    for p, f in zip(batch, first.tolist(), strict=True):
        for node, text in p.run:
            if text and (size := len(text)) and not text.isspace():
                at.append(node + f)
                chars.append(size)
                words.append(text.count(" ") + 1)
                marks.append(text.count(",") + text.count("."))
    at_ = np.array(at, np.int64)
    for k, v in enumerate((chars, words, marks)):
        np.add.at(own[:, k], at_, np.array(v, float))
    levels = by_depth(depth)
    in_link, above = is_link.copy(), np.zeros((n, len(TOKENS) + 5), bool)
    bits = (tokens[:, None] >> np.arange(len(TOKENS)) & 1).astype(bool)
    kinds = [np.isin(tag, [TAG_NO[t] for t in ts]) for ts in (("nav",), ("header", "footer"), ("aside", "form", "head"), ("article", "main"), ("li", "ul", "ol"))]
    mine = np.concatenate([bits, np.array(kinds).T], axis=1)
    for rows in levels[1:]:
        up = parent[rows]
        in_link[rows] |= in_link[up]
        above[rows] = above[up] | mine[up]
    own[:, 3] = own[:, 0] * in_link
    tree = own.copy()
    kids, blocks = np.zeros(n), np.zeros(n)
    for rows in reversed(levels[1:]):
        np.add.at(tree, parent[rows], tree[rows])
        np.add.at(kids, parent[rows], 1)
        np.add.at(blocks, parent[rows], ~inline[rows])
    up = np.maximum(parent, 0)
    is_first = parent < 0
    whole = tree[first][page_no]
    order = np.zeros(n)
    by_parent = np.lexsort((np.arange(n), parent))
    sorted_parent = parent[by_parent]
    start = np.r_[True, sorted_parent[1:] != sorted_parent[:-1]]
    order[by_parent] = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
    siblings = np.where(is_first, 1, kids[up])
    blocks_of = [
        tag[:, None] == np.arange(len(TAGS)),
        mine,
        above,
        depth,
        siblings,
        order / np.maximum(siblings - 1, 1),
        kids,
        blocks,
        np.log1p(own[:, 0]),
        np.log1p(tree[:, 0]),
        np.log1p(tree[:, 4]),
        tree[:, 0] / tree[:, 4],
        tree[:, 3] / np.maximum(tree[:, 0], 1),
        tree[:, 2] / np.maximum(tree[:, 1], 1),
        tree[:, 0] / np.maximum(whole[:, 0], 1),
        tree[:, 0] / np.maximum(tree[up, 0], 1),
        tag[up],
    ]
    widths = [b.shape[1] if b.ndim > 1 else 1 for b in blocks_of]
    x = np.empty((n, sum(widths)), np.float32)
    for b, end, width in zip(blocks_of, np.cumsum(widths).tolist(), widths, strict=True):
        x[:, end - width : end] = b.reshape(n, width)
    return x, parent, depth


class Boosted:
    """Trees as arrays: feature (-1 at a leaf), threshold, left, right, value."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    def keep_probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, f] <= threshold[at], left[at], right[at]))
            margin += value[at]
        return 1 / (1 + np.exp(-2 * margin))


_fitted: dict[tuple, Boosted] = {}


def fitted(spark: SparkSession, n_pages: int = TRAIN_PAGES, seed: int = SEED) -> Boosted:
    """The classifier, fitted by Spark ML once in a driver on n_pages generated pages."""
    key = (n_pages, seed)
    if key not in _fitted:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.functions import array_to_vector

        batch = [parsed(h) for h in pages(n_pages, seed)]
        x, _, _ = features(batch)
        y = np.concatenate([p.label for p in batch])
        rows = spark.createDataFrame(
            [(float(b), a.tolist()) for a, b in zip(x[y >= 0], y[y >= 0], strict=True)], "label double, x array<double>"
        )
        rows = rows.select("label", array_to_vector("x").alias("features")).coalesce(2).persist()
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, checkpointInterval=-1).fit(rows)
        rows.unpersist()
        trees = []
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            nodes: list[list[float]] = []

            def walk(node, weight=weight, nodes=nodes) -> int:
                own = len(nodes)
                nodes.append([-1, 0.0, 0, 0, node.prediction() * weight])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    nodes[own][:2] = [split.featureIndex(), split.threshold()]
                    nodes[own][2] = walk(node.leftChild())
                    nodes[own][3] = walk(node.rightChild())
                return own

            walk(tree._call_java("rootNode"))
            f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
            trees.append((f.astype(np.int64), t, left.astype(np.int64), right.astype(np.int64), v))
        _fitted[key] = Boosted(trees)
    return _fitted[key]


def decode(p: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The most probable choice in which no dropped node has a kept node below."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    drop, keep = np.log(1 - p), np.log(p)
    levels = by_depth(depth)
    for rows in reversed(levels[1:]):
        np.add.at(keep, parent[rows], np.maximum(keep[rows], drop[rows]))
        np.add.at(drop, parent[rows], drop[rows])
    kept = keep > drop
    kept[levels[0]] = True
    for rows in levels[1:]:
        kept[rows] &= kept[parent[rows]]
    return kept


def page_text(page: Page, kept: np.ndarray) -> str:
    """Text of kept nodes: white space within a block is one space, blocks are lines."""
    out, block = [], []
    for node, text in [*page.run, (0, None)]:
        if text is None:
            if block and (line := " ".join("".join(block).split())):
                out.append(line)
            block = []
        elif kept[node]:
            block.append(text)
    return "\n".join(out)


def texts_of(htmls: list[str | None], model: Boosted) -> list[str]:
    out: list[str] = []
    batch: list[Page] = []

    def judge() -> None:
        x, parent, depth = features(batch)
        kept = decode(model.keep_probability(x), parent, depth)
        at = 0
        for page in batch:
            out.append(page_text(page, kept[at : at + len(page.tag)]))
            at += len(page.tag)
        batch.clear()

    for k, html in enumerate(htmls):
        batch.append(parsed(html))
        if k + 1 == len(htmls) or sum(len(p.tag) for p in batch) > NODES_AT_ONCE:
            judge()
    return out


def main_text(html: Column, model: Boosted) -> Column:
    """Main text of each whole page.

    Null, empty and markup-only pages have the empty text; pages cut off in
    the middle are read as far as they go; repeated rows give equal texts.
    Pages are independent: nothing is shuffled.
    """

    @F.arrow_udf("string")
    def extract(htmls: pa.Array) -> pa.Array:
        return pa.array(texts_of(htmls.to_pylist(), model), pa.string())

    return extract(html)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: main text of every page."""
    found = table(spark, sf_dir, "pages").select("page_id", "url", main_text(F.col("html"), fitted(spark)).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
