"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities of neighbours.

A page is read once, as a stream of tags and text; no tree of elements is built. Block-level tags (and two line breaks in a row) end
a block. A block's features are its number of words and its share of linked words, the same of the block before and after it, its
kind (heading, paragraph, item of a list or table, other), its region (within an article, within what a tag, role or class
marks as menu, footer, advert, comment and so on, or neither) and whether the page has an article at all. The tree is Spark's,
trained on the small table LABELLED below; pages are then read by tasks of their own, without a shuffle.

Defined results: a null or empty page, and one without main text, has an empty text; repeated rows give a row each; an empty
table gives none. Pages of any length are read whole and in one pass. Only page_id, url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

from tessaro.llm.common import batch, map_texts

# Elements by what they do to a text.
#: Their contents are no text of the page.
DROPPED = set("audio button canvas datalist iframe map math noembed noframes noscript object picture progress script select style svg template textarea title video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
ITEMS = set("dd dt li td th".split())
#: A new one ends an open one of the same kind, if no other block is open within it.
UNENDED = set("dd dt li option p td th tr".split())
#: Regions that are never main text, by tag, role, and word of a class or id. An article within one of LASTING is no main text either.
OUT_TAGS = set("aside dialog footer form header menu nav".split())
OUT_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
OUT_WORDS = set(
    "ad ads advert advertisement advertising adverts alert banner billboard breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion rail recommended related replies reply respond search share sharing sidebar signin signup sitemap skip social sponsor sponsored subscribe subscription taboola teaser toast toolbar topbar warning widget widgets".split()
)
LASTING = set("aside comment commentlist comments discussion disqus footer nav navigation recommended related replies reply respond sidebar teaser widget widgets".split())
IN_TAGS = set("article main".split())
IN_WORDS = set("article articlebody body content entry main post story text".split())

ATTRIBUTES = r"""(?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>")
#: Where a quote is never closed, a tag ends at the next bracket.
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
MARKS = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+(?=[\s/]|$)""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Class names that tell of another region or of a state.
ABOUT_OTHERS = re.compile(r"(?:has|is|no|with|without)[-_]", re.IGNORECASE)

#: Region (in an article, out of the text, - neither), kind (p paragraph, h heading, i item, o other), words, linked words, and
#: whether the block is main text. Pages are apart by an empty line. Made by hand after common layouts of pages.
LABELLED = """
out i 1 1 no
out i 2 2 no
out o 9 0 no
in h 8 0 yes
in p 42 0 yes
in p 7 0 yes
in p 88 3 yes
in p 3 0 yes
in h 4 0 yes
in p 61 0 yes
in p 1 0 yes
out o 9 0 no

out h 3 3 no
out i 1 1 no
out i 3 3 no
out i 2 2 no
in h 11 0 yes
in p 6 2 yes
in p 120 6 yes
in p 54 20 yes
out o 2 0 no
in p 75 0 yes
in i 12 0 yes
in i 9 1 yes
in i 3 0 yes
in p 40 0 yes
out o 5 5 no
out h 2 0 no
out p 46 2 no
out p 33 1 no
out p 80 0 no
out i 3 3 no
- o 12 2 no

- o 3 3 no
- o 25 0 no
out o 30 1 no
in h 6 0 yes
in o 95 0 yes
in o 2 0 yes
in o 66 4 yes
in p 12 12 yes
in h 3 0 yes
in p 25 25 yes
- p 35 2 no
- h 4 0 no
- p 20 0 no
out p 24 8 no

out o 4 2 no
in h 5 5 yes
in p 28 0 yes
in o 2 2 no
in o 3 3 no
in o 1 1 no
in h 7 0 yes
in p 31 1 yes
in p 5 0 yes
in o 4 4 no
in i 2 2 no
in i 3 3 no
in i 4 4 no
in i 2 2 no
- p 50 0 no
- o 8 8 no

- i 1 1 no
- i 2 2 no
- i 1 1 no
- h 9 0 yes
- p 64 2 yes
- p 110 5 yes
- p 8 0 yes
- p 72 0 yes
- h 5 0 yes
- p 49 6 yes
- o 4 4 no
- o 3 3 no
- o 11 1 no

- o 2 2 no
- o 3 3 no
- h 7 0 yes
- o 51 0 yes
- o 83 2 yes
- o 10 0 yes
- o 45 1 yes
- o 6 5 no
- o 5 5 no
- o 9 0 no

- i 6 6 no
- i 4 4 no
- i 3 3 no
- i 58 1 yes
- i 90 4 yes
- i 140 0 yes
- i 7 7 no
- i 8 6 no
- i 5 0 no

- o 4 0 no
- o 1 1 no
- o 2 2 no
- h 3 3 no
- p 6 6 no
- p 5 5 no
- h 6 0 yes
- p 24 0 yes
- p 17 1 yes
- p 30 2 yes
- i 14 0 yes
- i 21 0 yes
- i 11 0 yes
- p 38 0 yes
- h 3 0 no
- i 5 5 no
- i 6 6 no
- i 4 4 no
- o 7 2 no

out i 2 2 no
out p 28 0 no
out o 16 3 no
- h 10 0 yes
- p 33 0 yes
- p 4 0 yes
- p 57 3 yes
- p 2 0 yes
- p 38 0 yes
- p 2 0 yes
- p 24 0 yes
- p 3 0 yes
- p 68 0 yes
out h 1 0 no
out p 40 0 no
out p 12 1 no
out o 14 2 no
- o 10 4 no

in h 4 0 yes
in p 15 0 yes
out p 15 0 no
in p 2 0 yes
out p 2 0 no
in p 9 4 yes
in i 20 0 yes
in i 4 0 yes
in i 6 3 yes
out i 6 0 no
in o 5 0 yes
in o 1 0 yes
- p 90 0 no
- o 1 0 no
- h 5 0 no
- i 30 4 no
- i 8 0 no

in h 6 0 yes
in p 30 0 yes
in p 4 0 yes

in p 50 1 yes

in o 12 0 yes

in p 3 0 yes

in h 2 2 yes
in p 4 1 yes
in p 3 2 yes
in p 2 1 yes
in i 3 1 yes
in p 1 0 yes
in p 4 4 yes

in h 3 0 yes
in i 2 0 yes
in i 8 0 yes
in p 1 0 yes

- p 80 0 yes

- o 45 2 yes

- o 14 0 yes

- o 6 0 yes

- h 5 0 yes
- p 60 0 yes
- p 33 0 yes

- o 3 0 no
- o 7 0 no
- h 8 0 yes
- p 44 0 yes
- p 70 2 yes
- p 12 0 yes
- p 39 0 yes
- o 4 0 no
- o 6 0 no
- o 3 0 no

- o 1 0 no
- o 2 0 no
- o 5 0 no

- i 1 0 no
- i 2 0 no
- i 3 0 no
- p 55 0 yes
- p 6 0 yes
- p 41 0 yes
- i 2 0 no
- i 4 0 no
- i 1 0 no
"""


class Block:
    __slots__ = ("text", "words", "linked", "kind", "region")

    def __init__(self, text: str, words: int, linked: int, kind: str, region: int) -> None:
        self.text, self.words, self.linked, self.kind, self.region = text, words, linked, kind, region


def marked(name: str, attributes: str) -> tuple[int, int]:
    """The region that an element begins (-1 out, 1 in, 0 as before), and what within it may be in again: 1 nothing, 0 an article, -1
    (a form, which may wrap a whole page) whatever is marked so."""
    words, roles, hidden = {name} & IN_TAGS, set(), False
    if attributes and name not in ("html", "body"):
        for m in MARKS.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                words.update(w.lower() for c in value.split() if not ABOUT_OTHERS.match(c) for w in WORDS.findall(c))
            elif key == "role":
                roles.add(value.lower())
            elif key == "itemprop":
                words.update({"articlebody"} & {value.lower()})
            else:
                hidden |= key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower()
    if words & OUT_WORDS or roles & OUT_ROLES or hidden:
        return -1, int(bool(words & LASTING))
    if name in OUT_TAGS:
        return -1, -1 if name == "form" else int(name in LASTING)
    return (1 if words & (IN_TAGS | IN_WORDS) or "main" in roles else 0), 0


class Reader:
    """The blocks of one page."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.stack: list[tuple[str, int, int, str]] = []
        self.open: dict[str, int] = {}
        self.region, self.lasting, self.kind, self.breaks = 0, 0, "o", 0

    def text(self, piece: str) -> None:
        if "&" in piece:
            piece = unescape(piece)
        self.parts.append(piece)
        if self.open.get("a"):
            self.linked.append(piece)
        if self.breaks and piece.strip():
            self.breaks = 0

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                n = text.count(" ") + 1
                self.blocks.append(Block(text, n, min(n, len("".join(self.linked).split())), self.kind, self.region))
            self.parts, self.linked = [], []
        self.breaks = 0

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.end_block()
            self.parts.append(" ")
            return
        block = name in BLOCKS
        if block:
            self.end_block()
            if self.open.get("p") and name != "p" or name in UNENDED:
                self.end_unended("p" if name not in UNENDED else name)
        elif name == "a" and self.open.get("a"):
            self.end("a")
        if name in VOID:
            return
        if not block and name != "a" and not attributes:
            return  # neither ends a block nor begins a region
        self.stack.append((name, self.region, self.lasting, self.kind))
        self.open[name] = self.open.get(name, 0) + 1
        if name == "a":
            return
        mark, lasting = marked(name, attributes)
        if name == "header" and self.region > 0 and mark < 0:
            mark = 0  # an article's own
        if mark < 0 or mark > 0 and (self.region >= 0 or self.lasting < 0 or self.lasting == 0 and name in IN_TAGS):
            if mark != self.region and not block:
                self.end_block()
            self.region, self.lasting = mark, max(lasting, self.lasting) if mark == self.region else lasting
        if block:
            self.kind = "h" if name in HEADINGS else "i" if name in ITEMS else "p" if name in ("p", "pre", "blockquote") else "o"

    def end_unended(self, name: str) -> None:
        """An open element whose end tag may be left out ends before another block, if it is the innermost block (links aside)."""
        for i in range(len(self.stack) - 1, -1, -1):
            inner = self.stack[i][0]
            if inner == name:
                return self.end_down_to(i)
            if inner in BLOCKS:
                return

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.end_block()
        if not self.open.get(name):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                return self.end_down_to(i)

    def end_down_to(self, i: int) -> None:
        if self.stack[i][1] != self.region:
            self.end_block()
        while len(self.stack) > i:
            name, self.region, self.lasting, self.kind = self.stack.pop()
            self.open[name] -= 1


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    reader, at, n, quotes = Reader(), 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            reader.text(page[at:lt])
        if lt == n:
            break
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
        elif after in ("!", "?") or after == "/" and not page[lt + 2 : lt + 3].isalpha():
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif not (after == "/" or after.isascii() and after.isalpha()):
            reader.text("<")
            at = lt + 1
        else:
            m = TAG.match(page, lt) if quotes else None
            if m is None:
                quotes = False
                m = BARE_TAG.match(page, lt)
            if m is None:
                break  # a tag that the page's end cuts off
            at, name = m.end(), m[2].lower()
            if m[1]:
                reader.end(name)
            elif name in DROPPED:
                if not m[3].endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                    end = page.find(">", close.end()) if close else -1
                    at = n if end < 0 else end + 1
            else:
                reader.start(name, m[3].strip())
    reader.end_block()
    return reader.blocks


def features(page: list[Block]) -> list[list[float]]:
    """Of each block: words and link density of it, of the one before and of the one after; kinds; region; whether the page has an article."""
    own = [(float(b.words), b.linked / b.words) for b in page]
    article = float(any(b.region > 0 for b in page))
    around = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [
        [*around[i + 1], *around[i], *around[i + 2], float(b.kind == "h"), float(b.kind == "i"), float(b.kind == "o"), float(b.region), article]
        for i, b in enumerate(page)
    ]


class Tree:
    """A trained tree as arrays, for tasks."""

    def __init__(self, root) -> None:
        self.feature, self.threshold, self.children, self.label = [], [], [], []
        self.add(root)
        self.feature, self.threshold, self.children, self.label = np.array(self.feature), np.array(self.threshold), np.array(self.children), np.array(self.label)

    def add(self, node) -> int:
        at = len(self.feature)
        leaf = node.subtreeDepth() == 0
        self.feature.append(-1 if leaf else node.split().featureIndex())
        self.threshold.append(0.0 if leaf else node.split().threshold())
        self.label.append(node.prediction() > 0.5)
        self.children.append((at, at))
        if not leaf:
            self.children[at] = (self.add(node.leftChild()), self.add(node.rightChild()))
        return at

    def main(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
            node = at[inner]
            at[inner] = self.children[node, (rows[inner, self.feature[node]] > self.threshold[node]).astype(int)]
        return self.label[at]


def labelled() -> list[tuple[float, list[float]]]:
    """LABELLED as (label, features)."""
    out = []
    for page in LABELLED.strip().split("\n\n"):
        rows = [line.split() for line in page.split("\n")]
        given = [Block("", int(w), int(a), kind, {"in": 1, "out": -1, "-": 0}[region]) for region, kind, w, a, _ in rows]
        out += [(float(r[4] == "yes"), f) for r, f in zip(rows, features(given), strict=True)]
    return out


def train(spark: SparkSession, depth: int = 8) -> Tree:
    rows = spark.createDataFrame([(y, Vectors.dense(x)) for y, x in labelled()], ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, maxBins=64, seed=1).fit(rows)
    return Tree(model._call_java("rootNode"))


def main_text(page: str, tree: Tree) -> tuple[str, int, int]:
    """Text, blocks, and blocks that are main text."""
    found = blocks(page)
    if not found:
        return "", 0, 0
    kept = tree.main(np.array(features(found)))
    return "\n\n".join(b.text for b, k in zip(found, kept, strict=True) if k), len(found), int(kept.sum())


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars, n_blocks, n_main: a row for each page."""
    tree = train(pages.sparkSession)

    def run(batches: Iterator[tuple[list, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        for (ids, urls), whole in batches:
            found = [main_text(html.decode("utf-8", "replace"), tree) for html in whole]
            text = [t for t, _, _ in found]
            yield batch(
                page_id=pa.array(ids, pa.int64()),
                url=pa.array(urls, pa.string()),
                text=pa.array(text, pa.string()),
                n_chars=pa.array([len(t) for t in text], pa.int64()),
                n_blocks=pa.array([n for _, n, _ in found], pa.int64()),
                n_main=pa.array([n for _, _, n in found], pa.int64()),
            )

    return map_texts(pages, ["page_id", "url"], run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long", text="html")
