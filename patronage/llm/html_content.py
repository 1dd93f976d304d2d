"""Main-text extraction with a tree-structured graphical model over the DOM.

A page is parsed into a tree of elements, with a leaf for each run of text that no block boundary cuts. Every node is
a variable, content or not. A node's own potential is a logistic function of its features (tag, what its class, id and
role words say, length, share of text inside links, punctuation), an edge's potential depends on the kinds of the
parent's and the child's tags. Class words are features only: the messages decide. One sum-product pass upward and one downward give every node's marginal, and leaves at or above one half are the text.

Potentials are trained from labelled pages: the small hand-labelled layouts of ``labelled_pages`` and, if asked for,
pages of the corpus whose own semantic markup labels them (at most ``sample`` pages of 200 to 50,000 bytes, chosen by
hash; a documented bound of the training set, by rows however often a page_id repeats). Node weights are a ridge logistic regression, edge tables are smoothed counts.

Scripts, styles, templates and form controls are never text, and do not cut the block they stand in; formulas are text
of their block. Character references are decoded, white space inside a
block becomes one space, blocks are trimmed, and blocks stand in page order with two newlines between.

Edge cases: null and empty html give the empty text; text without markup is one block; broken markup is closed as
browsers close it, roughly; a page is parsed in time linear in its length, however deep or broken its markup (of
which quotes that never close lose their meaning); rows that repeat a page_id each get a result.
Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.labelled_pages import PAGES

SAMPLE, SEED, COPIES = 200, 9, 8

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg iframe object canvas head title select option textarea button input audio video map datalist annotation annotation-xml".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select body html td th article section div main aside nav".split())
KINDS = {
    **dict.fromkeys(["nav", "menu"], "nav"), **dict.fromkeys(["header", "footer", "aside", "form"], "edge"), "dialog": "edge",
    **dict.fromkeys(["article", "main"], "main"), **dict.fromkeys(["section", "div", "body", "html", "center", "table", "tbody", "tr", "td", "details"], "box"),
    **dict.fromkeys("p blockquote pre figure figcaption dl dt dd th caption address summary".split(), "block"), **dict.fromkeys("h1 h2 h3 h4 h5 h6 hgroup".split(), "head"),
    **dict.fromkeys(["ul", "ol", "dir"], "list"), "li": "item", "a": "link",
}
#: Words of class, id and role attributes, by what they say.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip",
    "top": "header masthead banner topbar branding logo",
    "foot": "footer copyright colophon legal bottom",
    "side": "sidebar aside side rail widget widgets related recommended trending popular complementary recirc",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay toast announcement paywall",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted banner-ad dfp",
    "form": "form search login signin signup subscribe subscription newsletter contact",
    "talk": "comment comments reply replies respond discussion disqus reviews",
    "share": "share sharing social follow tweet buttons",
    "main": "article content main post entry story body text hentry prose page-content richtext",
}
CUE_OF = {w: k for k, words in CUES.items() for w in words.split()}

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
LABEL = re.compile(r"\bdata-main\b")
WORD = re.compile(r"[a-z]+(?:-[a-z]+)?|[a-z]+")
BLANK = re.compile(r"[ \t\n\r\f\v]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    kind: str
    skip: bool = False
    marked: bool = False
    cues: frozenset = frozenset()
    text: str = ""
    chars: int = 0
    linked: int = 0
    own: list = field(default_factory=list)


def _kind(tag: str) -> str:
    return "root" if tag in ("html", "body") else KINDS.get(tag, "inline" if tag in INLINE else "box")


class Markup:
    """Reads a page's markup from left to right; what it has learned of the rest keeps it from looking again."""

    def __init__(self, page: str) -> None:
        self.page, self.quotes, self.closers = page, {'"', "'"}, True

    def tag_end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends (its ``>``), or -1 if it does not."""
        place = at
        while self.closers:
            place = PLAIN.match(self.page, place).end()
            if place == len(self.page):
                break
            if self.page[place] == ">":
                return place
            quote = self.page[place]
            stop = self.page.find(quote, place + 1) if quote in self.quotes else place
            if stop < 0:  # no such quote is left, here or later
                self.quotes.discard(quote)
                stop = place
            place = stop + 1
        # The rest has no ``>`` outside quotes; from here on quotes mean nothing.
        self.quotes.clear()
        stop = self.page.find(">", at) if self.closers else -1
        self.closers = stop >= 0
        return stop

    def next_tag(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(start, end, name, attributes, closes) of the first tag from ``at`` on; comments and the like have no name."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            m = NAME.match(page, at)
            if m:
                stop = self.tag_end(m.end())
                if stop < 0:
                    return at, len(page), "", "", False
                return at, stop + 1, m[1].lower(), page[m.end() : stop], page[at + 1] == "/"
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                return at, len(page) if stop < 0 else stop + 3, "", "", False
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                stop = page.find(">", at)
                return at, len(page) if stop < 0 else stop + 1, "", "", False
            at += 1
        return None


class Tree:
    """The nodes of a page as they are read, with the open elements by place and by tag."""

    def __init__(self) -> None:
        self.nodes = [Node("html", -1, "root")]
        self.stack, self.blocks = [0], [0]  # open elements; places in the stack of those that are no inline elements
        self.open: dict[str, list[int]] = {}  # places in the stack of each open tag
        self.run: list[str] = []
        self.linked = 0

    def last(self, tags) -> int:
        """The highest place in the stack with one of these tags, 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def flush(self) -> None:
        if self.run:
            text = BLANK.sub(" ", html.unescape("".join(self.run))).strip()
            self.run.clear()
            if text:
                top = self.stack[self.blocks[-1]]
                self.nodes.append(Node("#", top, "text", marked=self.nodes[top].marked, text=text, chars=len(text), linked=min(self.linked, len(text))))
        self.linked = 0

    def say(self, text: str) -> None:
        if text and not self.nodes[self.stack[-1]].skip:
            self.run.append(text)
            if len(self.stack) - self.last("a") <= 4 and self.open.get("a"):
                self.linked += len(text.strip())

    def push(self, node: Node) -> None:
        place = len(self.stack)
        self.stack.append(len(self.nodes))
        self.nodes.append(node)
        self.open.setdefault(node.tag, []).append(place)
        if node.tag not in INLINE and not node.skip:
            self.blocks.append(place)

    def close(self, place: int) -> None:
        """Close the element at ``place`` of the stack and all inside it."""
        while len(self.stack) > place:
            self.open[self.nodes[self.stack.pop()].tag].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()


def parse(page: str) -> list[Node]:
    """Nodes of the page, parents before children; leaves have tag ``#`` and their text."""
    tree, markup, at = Tree(), Markup(page), 0
    nodes = tree.nodes
    while (found := markup.next_tag(at)) is not None:
        start, end, tag, attrs, closes = found
        tree.say(page[at:start])
        at = end
        if not tag:
            continue
        if closes:
            place = tree.last((tag,)) if tag not in VOID else 0
            # An inline end tag does not close the blocks that have begun inside its element.
            if place and not (tag in INLINE and tree.blocks[-1] > place):
                if tree.blocks[-1] >= place:
                    tree.flush()
                tree.close(place)
            continue
        if tag == "br":
            tree.say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                tree.flush()
            continue
        if tag in CLOSES_P and (place := tree.last("p")):
            tree.flush()
            tree.close(place)
        if tag in SIBLINGS:
            place, scope = tree.last(SIBLINGS[tag]), tree.last(SCOPES - SIBLINGS[tag] - ({"td", "th"} if tag == "tr" else set()))
            if place > scope:
                tree.flush()
                tree.close(place)
        top = nodes[tree.stack[-1]]
        skip = top.skip or tag in SKIPPED
        if tag not in INLINE and not skip:
            tree.flush()
        cues = frozenset(CUE_OF[w] for a in ATTR.finditer(attrs) for w in WORD.findall((a[2] or a[3] or a[4] or "").lower().replace("_", " ")) if w in CUE_OF) if attrs else frozenset()
        node = Node(tag, tree.stack[-1], _kind(tag), skip, top.marked or bool(attrs and LABEL.search(attrs)), cues)
        if tag == "body" and attrs and len(tree.stack) < 3:
            nodes[0].marked = node.marked
        if attrs.endswith("/") and (skip or tag in INLINE):
            continue
        tree.push(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else len(page)
    tree.say(page[at:])
    tree.flush()
    for node in reversed(nodes):
        if node.parent >= 0:
            nodes[node.parent].chars += node.chars
            nodes[node.parent].linked += node.linked
    return nodes


def features(nodes: list[Node]) -> None:
    """Names of the features each node has."""
    for k, node in enumerate(nodes):
        size = 0 if node.chars < 25 else 1 if node.chars < 80 else 2 if node.chars < 250 else 3
        share = 0 if node.linked * 10 < node.chars else 1 if node.linked * 2 < node.chars else 2
        if node.tag == "#":
            up = nodes[node.parent]
            marks = sum(map(node.text.count, ".,;:"))
            node.own = [f"text size {size}", f"text links {share}", f"text in {up.kind}", f"text in {up.kind} size {size}", f"text marks {min(marks, 4)}"]
            if "©" in node.text[:40] or "copyright" in node.text[:60].lower():
                node.own.append("text rights")
        else:
            node.own = [f"tag {node.tag}", f"kind {node.kind}", f"{node.kind} links {share}", f"{node.kind} size {size}"]
            if node.tag not in INLINE:
                node.own += [f"cue {c}" for c in node.cues]
                if node.cues:
                    node.own.append("cues " + " ".join(sorted(node.cues)))
            if node.parent == 0 or k and nodes[node.parent].tag == "body":
                node.own.append(f"outer {node.tag}")


@dataclass
class Model:
    weights: dict[str, float]
    edges: dict[tuple[str, str], tuple[tuple[float, float], tuple[float, float]]]
    trust: float = 0.7

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, by messages up to the root and down again."""
        w, same = self.weights, ((0.9, 0.1), (0.1, 0.9))
        own = []
        for node in nodes:
            z = self.trust * sum(w.get(name, 0.0) for name in node.own)
            p = 1 / (1 + math.exp(-max(-15.0, min(15.0, z))))
            own.append((1 - p, p))
        up, sent, tables = list(own), [(1.0, 1.0)] * len(nodes), [same] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            node = nodes[k]
            t = self.edges.get((nodes[node.parent].kind, node.kind), same)
            b0, b1 = up[k]
            m0, m1 = t[0][0] * b0 + t[0][1] * b1, t[1][0] * b0 + t[1][1] * b1
            s = m0 + m1
            sent[k], tables[k] = (m0 / s, m1 / s), t
            p0, p1 = up[node.parent]
            p0, p1 = p0 * sent[k][0], p1 * sent[k][1]
            s = p0 + p1
            up[node.parent] = (p0 / s, p1 / s)
        belief = list(up)
        for k in range(1, len(nodes)):
            p0, p1 = belief[nodes[k].parent]
            p0, p1 = p0 / max(sent[k][0], 1e-12), p1 / max(sent[k][1], 1e-12)
            t = tables[k]
            d0, d1 = p0 * t[0][0] + p1 * t[1][0], p0 * t[0][1] + p1 * t[1][1]
            b0, b1 = up[k][0] * d0, up[k][1] * d1
            s = b0 + b1 or 1.0
            belief[k] = (b0 / s, b1 / s)
        return [b[1] for b in belief]


def _truth(nodes: list[Node]) -> list[bool]:
    """Label of each node: that of most of its text; an element without text has its parent's mark."""
    good = [n.chars if n.tag == "#" and n.marked else 0 for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].tag != "#" or nodes[k].parent >= 0:
            good[nodes[k].parent] += good[k]
    return [g * 2 > n.chars if n.chars else n.marked for g, n in zip(good, nodes, strict=True)]


def _semantic(nodes: list[Node]) -> bool:
    """Mark the nodes inside article or main and outside other semantic parts; whether the page has both sorts."""
    inside = [False] * len(nodes)
    for k, node in enumerate(nodes):
        up = inside[node.parent] if k else False
        inside[k] = (up or node.kind == "main") and node.kind not in ("nav", "edge") and not node.cues & {"talk", "advert", "side", "share", "notice", "form", "menu"}
        node.marked = inside[k]
    leaves = [n.marked for n in nodes if n.tag == "#"]
    return any(leaves) and not all(leaves)


def fit(trees: list[list[Node]], steps: int = 300, ridge: float = 0.003) -> Model:
    """Node weights by logistic regression and edge tables by smoothed counts, over labelled trees."""
    names: dict[str, int] = {}
    rows, labels, counts = [], [], {}
    for nodes in trees:
        features(nodes)
        truth = _truth(nodes)
        for k, node in enumerate(nodes):
            if node.skip or not node.chars:
                continue
            rows.append([names.setdefault(x, len(names)) for x in node.own])
            labels.append(truth[k])
            if k:
                table = counts.setdefault((nodes[node.parent].kind, node.kind), np.array([[4.0, 0.5], [0.5, 4.0]]))
                table[int(truth[node.parent]), int(truth[k])] += 1
    lengths = np.array([len(r) for r in rows])
    flat, owner, y = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), lengths), np.array(labels, float)
    w = np.zeros(len(names))
    seen = np.bincount(flat, minlength=len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(owner, w[flat], len(rows))))
        g = np.bincount(flat, (y - p)[owner], len(names)) / len(rows) - ridge * w
        w += 3.0 * g / np.sqrt(seen / len(rows) + 1e-3)
    edges = {k: tuple(tuple((row / row.sum()).tolist()) for row in t) for k, t in counts.items()}
    return Model({n: float(w[k]) for n, k in names.items()}, edges)


def train(pages: DataFrame | None = None, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, seed: int = SEED) -> Model:
    """Potentials from the labelled layouts and from pages that their own markup labels."""
    trees = [parse(p) for p in PAGES for _ in range(COPIES)]
    if pages is not None:
        known = pages.where(F.octet_length(html_col).between(200, 50_000)).select(F.col(id_col).alias("i"), F.col(html_col).alias("h"))
        # The ids are chosen first, so that tasks send the driver ids and not their own best pages.
        chosen = known.select("i").distinct().orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(sample)
        for row in known.join(F.broadcast(chosen), "i", "left_semi").orderBy("i", F.xxhash64("h")).limit(sample).collect():
            nodes = parse(row["h"])
            if _semantic(nodes):
                trees.append(nodes)
    return fit(trees)


def _framed(nodes: list[Node], k: int) -> bool:
    """Whether a node lies in an element that is a menu, header, footer or aside by its tag."""
    while k > 0:
        if nodes[k].kind in ("nav", "edge"):
            return True
        k = nodes[k].parent
    return False


def main_text(page: str | None, model: Model) -> str:
    """The text of one page."""
    if not page:
        return ""
    nodes = parse(page)
    features(nodes)
    blocks = [k for k, n in enumerate(nodes) if n.tag == "#" and n.text]
    if len(blocks) == 1 and not _framed(nodes, blocks[0]):  # nothing on the page that it could be beside
        return nodes[blocks[0]].text
    return "\n\n".join(n.text for n, p in zip(nodes, model.marginals(nodes), strict=True) if n.tag == "#" and p >= 0.5)


def extract_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points), for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [main_text(x.as_py(), own) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("page_html")).mapInArrow(each, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
