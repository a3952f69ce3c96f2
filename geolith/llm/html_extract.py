"""HTML extraction (8) by minimum-cut labelling.

A page is cut into text blocks. A logistic classifier of each block's text, with a prior for the
markup around it, gives two costs, for calling it content or boilerplate; they are the capacities
from the source and to the sink. Edges between neighbours in page order, stronger the closer they
are in the tree, and between blocks of one parent are the cost of unlike labels. The minimum cut is
the cheapest labelling; blocks on the source's side are the main text. The text of a short paragraph or of a list of
links speaks for boilerplate; what stands around it decides.

The classifier's weights are fitted by `fit` on blocks whose label the markup gives away; the markup
is not among its features.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "page_id long, url string, text string, n_chars long"
#: A start or end tag with quoted attributes, of at most 256 runs between quotes.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,256}+)>")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose content is not markup, never shown as the page's text, or a form's.
RAW = frozenset("script style title textarea iframe noembed noframes xmp template desc metadata defs annotation annotation-xml object select option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A paragraph ends where one of these begins.
_ENDS_P = BLOCK - {"html", "body", "button", "noscript"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote dd figcaption td".split())
#: Prior log odds of content for standing inside an element, and for words of its class, id or role: the least and the largest around a block count.
AGAINST, FOR = -8.0, 3.0
PLACE = {x: AGAINST for x in "nav header footer aside form menu dialog button search".split()} | {"legend": -4.0, "label": -4.0, "noscript": -2.0, "article": FOR, "main": 2.0}
NAMES = {
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner": AGAINST,
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc": AGAINST,
    "header masthead topbar footer contentinfo colophon copyright": AGAINST,
    "sidebar aside complementary widget related recommended recommendations trending share sharing social": AGAINST,
    "comment comments commentlist reply replies respond discussion disqus": AGAINST,
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search": AGAINST,
    "article content entry post story main body text prose": 1.0,
}
_NAMES = {w: x for words, x in NAMES.items() for w in words.split()}
#: A class or id with one of these words tells of the layout around, not of what is inside.
_LAYOUT = frozenset("no has with without hide wrap wrapper container layout grid row col columns".split())
FEATURES = ("constant", "words", "links", "sentence", "heading", "paragraph", "sign", "middle")
#: What fitting starts from and is held near to, by the names of FEATURES; and the weights, as fit() gives them for the first 2000 pages of sf0.1.
EXPECTED = (-2.5, 0.8, -4.0, 0.5, 1.5, 1.0, -2.0, 0.5)
WEIGHTS = (-2.37, 0.73, -4.04, 0.39, 1.92, 2.52, -2.25, 0.49)
#: Most that a block's text may say, in log odds.
MOST = 4.0
#: Cost of unlike neighbours with the same parent, its decay for each step in the tree between them, and the cost of unlike blocks of one parent that others stand between.
SMOOTH, DECAY, APART = 2.0, 0.4, 1.0
#: Words at which a text's say is 63 % of its odds: a short one says little by itself.
SHORT = 4.0


class Block(NamedTuple):
    """A text block: share of its characters in links, whether it is (in) a heading or paragraph, the markup's prior, number of its parent element,
    and steps in the tree from the block before, beyond those between siblings."""

    text: str
    links: float
    heading: bool
    paragraph: bool
    prior: float
    parent: int
    steps: int


def names_weight(name: str, attributes: str) -> tuple[float, float, bool]:
    """What an element's attributes say against and for content, and whether they hide it."""
    low, high, hidden = 0.0, 0.0, False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id", "role"):
            for token in value.split():
                words = [x for x in re.split(r"[^a-z]+", token) if x]
                if name in ("html", "body") or not _LAYOUT.isdisjoint(words):
                    continue
                for word in words:
                    x = _NAMES.get(word, 0.0)
                    low, high = min(low, x), max(high, x)
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            hidden |= key == "hidden" or value == "true"
    return low, high, hidden


class Parser:
    """Blocks of a page in page order, in time linear in its length: each tag costs what it opens or closes."""

    def __init__(self, page: str):
        self.page, self.out = page, []
        self.stack: list[tuple[str, float, float, int, int]] = []  # name, against, for, number, links around
        self.places: dict[str, list[int]] = {}  # where elements of a name stand in the stack
        self.levels: list[int] = []  # where block elements stand
        self.parts: list[str] = []
        self.linked = self.number = self.lowest = self.depth = 0
        self.heading = False
        self.run()
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                top, levels = self.stack[-1] if self.stack else ("", 0.0, 0.0, 0, 0), self.levels
                own = self.stack[levels[-1]][0] if levels else ""
                parent = self.stack[levels[-2]][3] if len(levels) > 1 else 0
                steps = max(0, self.depth + len(levels) - 2 * self.lowest - 2) if self.out else 0
                self.out.append(Block(text, min(1.0, self.linked / len(text)), self.heading, own in PARAGRAPHS, top[1] + top[2], parent, steps))
                self.depth = self.lowest = len(levels)
            self.parts.clear()
        self.linked = 0

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.stack and self.stack[-1][4]:
                self.linked += len(text.strip())
            self.heading = not HEADINGS.isdisjoint(x[0] for x in self.stack[-3:])

    def open(self, name: str, attributes: str) -> None:
        low, high, hidden = names_weight(name, attributes) if attributes else (0.0, 0.0, False)
        inside = self.places.get("article") or self.places.get("main")
        x = 0.0 if name in ("header", "noscript") and inside else PLACE.get(name, 0.0)
        _, low0, high0, _, links = self.stack[-1] if self.stack else ("", 0.0, 0.0, 0, 0)
        self.number += 1
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.levels.append(len(self.stack))
        self.stack.append((name, min(low0, low, x, 5 * AGAINST * hidden), max(high0, high, x), self.number, links + (name == "a")))

    def close(self, k: int) -> None:
        """Close all elements from place k of the stack."""
        for x in self.stack[k:]:
            self.places[x[0]].pop()
        del self.stack[k:]
        while self.levels and self.levels[-1] >= k:
            self.levels.pop()
        self.lowest = min(self.lowest, len(self.levels))

    def top_block(self) -> str:
        return self.stack[self.levels[-1]][0] if self.levels else ""

    def run(self) -> None:
        page, at, end = self.page, 0, len(self.page)
        last = page.rfind(">")
        while at < end:
            i = page.find("<", at)
            if i < 0:
                self.add(page[at:])
                return
            kind = page[i + 1 : i + 2]
            if page.startswith("</>", i):
                self.add(page[at:i])
                at = i + 3
                continue
            if kind in ("!", "?"):
                self.add(page[at:i])
                j = page.find("-->", i + 4) if page.startswith("<!--", i) else page.find(">", i)
                if j < 0:
                    return
                at = page.index(">", j) + 1
                continue
            tag = kind.isascii() and kind.isalpha() or kind == "/" and i + 2 < end
            if tag and i > last:
                self.add(page[at:i])  # a cut tag
                return
            m = TAG.match(page, i) if tag else None
            if m is None:
                if tag and kind == "/" and not page[i + 2].isalpha():
                    self.add(page[at:i])
                    at = page.index(">", i) + 1
                else:
                    self.add(page[at : i + 1])
                    at = i + 1
                continue
            self.add(page[at:i])
            at, name = m.end(), m[2].lower()
            if m[1]:
                if name in BLOCK:
                    self.flush()
                where = self.places.get(name)
                if where and (name in BLOCK or not self.levels or self.levels[-1] < where[-1]):
                    self.close(where[-1])
            elif name in RAW:
                if not (m[3].rstrip().endswith("/") and name in ("desc", "metadata", "defs", "annotation", "annotation-xml")):
                    shut = _shut(name).search(page, at)
                    at = shut.end() if shut else end
            elif name in VOID:
                if name in BLOCK:
                    self.flush()
                elif name in ("br", "wbr"):
                    self.parts.append(" " if name == "br" else "")
            elif name != "head":
                if name in BLOCK:
                    self.flush()
                    if name in _ENDS_P and self.top_block() == "p":
                        self.close(self.levels[-1])
                    if name in _SAME and self.stack and self.stack[-1][0] in _SAME[name]:
                        self.close(len(self.stack) - 1)
                self.open(name, m[3])


#: An open element of these names ends where one of the others begins.
_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_SHUT: dict[str, re.Pattern] = {}


def _shut(name: str) -> re.Pattern:
    if name not in _SHUT:
        _SHUT[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
    return _SHUT[name]


def blocks(page: str) -> list[Block]:
    """Each block with text, in page order."""
    return Parser(page).out


def features(own: list[Block]) -> np.ndarray:
    """(blocks, FEATURES): of the text and its place alone, nothing of the markup's names or of what stands around."""
    n, words = len(own), [b.text.count(" ") + 1 for b in own]
    rows = [(1.0, math.log(k), b.links, b.text[-1] in ".!?…:;\"'”»)", b.heading, b.paragraph, "©" in b.text, 2 * min(i, n - 1 - i) / n) for i, (b, k) in enumerate(zip(own, words))]
    return np.array(rows, float).reshape(n, len(FEATURES))


def odds(own: list[Block], weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """Each block's log odds of content: what its text says, at most MOST and less if it is short, and the markup's prior."""
    x = features(own)
    said = np.clip(x @ np.array(weights), -MOST, MOST) * (1 - np.exp(-np.exp(x[:, 1]) / SHORT))
    return [float(v) + b.prior for v, b in zip(said, own)]


def costs(odds: float) -> tuple[float, float]:
    """The logistic classifier's costs of calling a block boilerplate and content: its negative log probabilities."""
    wrong = math.log1p(math.exp(-abs(odds)))
    return (abs(odds) + wrong, wrong) if odds > 0 else (wrong, abs(odds) + wrong)


def edges(own: list[Block]) -> list[tuple[int, int, float]]:
    """Costs of unlike labels: of neighbours in page order, and of blocks of one parent that others stand between."""
    out = [(i - 1, i, SMOOTH * DECAY ** min(own[i].steps, 50)) for i in range(1, len(own))]
    last: dict[int, int] = {}
    for i, b in enumerate(own):
        if (j := last.get(b.parent, i)) < i - 1:
            out.append((j, i, APART))
        last[b.parent] = i
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut; of equal cuts, that with the most nodes at the source.

    First the network is reduced: a node with at most two neighbours is taken out, and what it lets flow
    between them and the terminals becomes capacities of theirs (any cost of two labels for which unlike ones cost
    more is a pair of terminals and an edge). Arcs over a page never cross, so such a node is always left
    and the reduction alone settles a page, in linear time. What it leaves of other graphs is cut by
    maximum flow. Labels are then read back in reverse order.
    """
    n = len(source)
    pull = [s - t for s, t in zip(source, sink)]  # what calling a node boilerplate costs, less calling it content
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    todo, gone, order = deque(range(n)), [False] * n, []
    while todo:
        i = todo.popleft()
        if gone[i] or len(near[i]) > 2:
            continue
        gone[i] = True
        around = list(near[i].items())
        order.append((i, pull[i], around))
        for j, _ in around:
            del near[j][i]
            todo.append(j)
        if len(around) == 1:
            (j, w), p = around[0], pull[i]
            # with j content: min(w, p if boilerplate is worse); the difference of j's two cases
            pull[j] += max(-w, min(w, p))
        elif len(around) == 2:
            (j, v), (k, w), p = *around, pull[i]
            # least cost over i's label, of labels (j, k); content costs max(0, -p), boilerplate max(0, p)
            both = min(max(0.0, -p), max(0.0, p) + v + w)
            none = min(max(0.0, -p) + v + w, max(0.0, p))
            only_j = min(max(0.0, -p) + w, max(0.0, p) + v)
            only_k = min(max(0.0, -p) + v, max(0.0, p) + w)
            # none + x_j * a + x_k * b + e * (x_j xor x_k) / 2, solved for a, b, e
            a = (only_j - only_k + both - none) / 2
            b = (only_k - only_j + both - none) / 2
            e = (only_j + only_k - both - none) / 2
            pull[j] -= a
            pull[k] -= b
            if e > 0:
                near[j][k] = near[j].get(k, 0.0) + e
                near[k][j] = near[k].get(j, 0.0) + e
    label: list[bool] = [False] * n
    rest = [i for i in range(n) if not gone[i]]
    if rest:
        for i, x in zip(rest, _by_flow(rest, pull, near)):
            label[i] = x
    for i, p, around in reversed(order):
        label[i] = p + sum(w if label[j] else -w for j, w in around) >= -1e-9
    return label


def _by_flow(rest: list[int], pull: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Labels of the nodes that are left, by maximum flow along shortest augmenting paths."""
    s, t = -1, -2
    flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {s: {}, t: {}}
    for i in rest:
        flow[s][i], flow[i][s] = max(0.0, pull[i]), 0.0
        flow[i][t], flow[t][i] = max(0.0, -pull[i]), 0.0
    while True:
        back, queue = {s: s}, deque([s])
        while queue and t not in back:
            i = queue.popleft()
            for j, w in flow[i].items():
                if w > 1e-12 and j not in back:
                    back[j] = i
                    queue.append(j)
        if t not in back:
            break
        path, j = [], t
        while j != s:
            path.append((back[j], j))
            j = back[j]
        w = min(flow[i][j] for i, j in path)
        for i, j in path:
            flow[i][j] -= w
            flow[j][i] += w
    boiler, queue = {t}, deque([t])
    while queue:
        j = queue.popleft()
        for i in flow[j]:
            if i not in boiler and flow[i][j] > 1e-12:
                boiler.add(i)
                queue.append(i)
    return [i not in boiler for i in rest]


def labelled(page: str | None, weights: tuple[float, ...] = WEIGHTS) -> list[tuple[Block, float, bool]]:
    """Each block with its log odds and whether it is content."""
    own = blocks(page or "")
    said = odds(own, weights)
    terminals = [costs(x) for x in said]
    return list(zip(own, said, minimum_cut([x[0] for x in terminals], [x[1] for x in terminals], edges(own))))


def main_text(page: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    """The main text of a page: its content blocks, each with single spaces, joined by line ends."""
    return "\n".join(b.text for b, _, k in labelled(page, weights) if k)


def fit(pages: list[str], penalty: float = 0.02, rounds: int = 30) -> tuple[float, ...]:
    """Weights of the classifier from blocks of pages that the markup labels: content with a prior of FOR or more, boilerplate with nearly AGAINST or less.

    A bounded sample of pages, as a list; other blocks are not looked at. Logistic regression, both labels with
    equal mass, with a penalty on what differs from EXPECTED: what the sample's pages have only in one form is
    learned from them, what they hardly show stays as expected. The same for the same pages.
    """
    rows, label = [], []
    for page in pages:
        own = blocks(page)
        marked = [k for k, b in enumerate(own) if b.prior >= FOR or b.prior <= AGAINST + FOR]
        rows.append(features(own)[marked])
        label += [own[k].prior > 0 for k in marked]
    x, y = np.concatenate(rows), np.array(label, float)
    mass = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = expected = np.array(EXPECTED)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (mass * (p - y)) + penalty * (w - expected)
        bend = (x * (mass * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return tuple(round(float(v), 2) for v in w)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars (code points): a row per row of pages.

    A null html is empty. Whole pages are read; nothing but boilerplate is dropped. Cut and malformed
    pages are read as far as they go. Null ids and urls stay null, repeated rows repeat, other columns are
    not read; an empty table gives none. A page takes time and memory in proportion to its length.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(go, RESULT)
