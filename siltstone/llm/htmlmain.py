"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. A block is described by its word count and link density, by
those of the blocks before and after it, and by what its enclosing elements say (article, menu, footer
and so on). A small decision tree, trained on the table of labelled blocks below, tells main text from
the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm._common import slices

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
_SILENT = frozenset("script style noscript template iframe object svg math textarea select button title head audio video canvas map".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER = frozenset("nav footer aside form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_MAIN = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class names and ids that speak of something beside the text, and parts that say nothing of it. A name counts
#: if all of its parts are of these two kinds and one is of the first: "site-header" does, "share-price" doesn't.
_HINT = re.compile(
    r"ads?|adsense|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|newsletter|subscri\w*|popup|modal|overlay|"
    r"sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|related|recommend\w*|share|sharing|social|"
    r"comments?|commentlist|disqus|respond|replies|widget|toolbar|pagination|pager|login|signup|search|skip|alert"
)
_PLAIN = re.compile(
    r"side|site|page|main|top|bottom|left|right|box|block|wrapper|wrap|container|list|items?|links?|bar|area|section|inner|outer|global|primary|"
    r"secondary|sub|btn|buttons?|icons?|form|posts|articles|stories|slot|unit|zone|panel|module|head|foot|row|col|column|"
    r"small|large|mobile|desktop|sticky|fixed|js|is|has|the|to|us|by|of|in|on|[0-9a-f]*\d[0-9a-f]*|[a-z]"
)
_PARTS = re.compile(r"[a-z]+|\d+|[^\W\d_]+")


@lru_cache(10_000)
def _aside(name: str) -> bool:
    """Whether a class name or id speaks of a menu, an advert or the like."""
    parts = _PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
    hints = [bool(_HINT.fullmatch(p)) for p in parts]
    return any(hints) and all(h or _PLAIN.fullmatch(p) for h, p in zip(hints, parts, strict=True))


#: An element that only these close when it is left open.
_ENDS_P = _BLOCK - {"option", "caption"}


@dataclass
class Block:
    text: str
    words: int
    linked: float
    boiler: bool
    main: bool
    heading: bool
    item: bool


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # element, whether it is boilerplate, whether it is silent
        self.counts = dict.fromkeys(("boiler", "silent", "main", "a", "heading", "item"), 0)
        self.parts: list[str] = []
        self.link_chars = self.chars = 0
        self.blocks: list[Block] = []
        self.state = (False, False, False, False)

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.blocks.append(Block(" ".join(words), len(words), self.link_chars / max(1, self.chars), *self.state))
            self.parts, self.link_chars, self.chars = [], 0, 0

    def _count(self, tag: str, boiler: bool, silent: bool, by: int) -> None:
        c = self.counts
        c["boiler"] += by * boiler
        c["silent"] += by * silent
        for key, hit in (("main", tag in _MAIN), ("a", tag == "a"), ("heading", tag in _HEADINGS), ("item", tag in ("li", "td", "th", "dd", "dt"))):
            c[key] += by * hit

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
        elif tag == "br" or tag == "img":
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag in _ENDS_P and any(x[0] == "p" for x in self.open[-12:]):
            self._close("p", stop=_BLOCK - {"p"})
        if tag in ("li", "option", "dd", "dt", "tr", "td", "th"):
            self._close(tag, stop=frozenset(("ul", "ol", "menu", "dl", "table", "select", *(("tr",) if tag in ("td", "th") else ()))))
        a = {k: v or "" for k, v in attrs}
        boiler = tag in _BOILER or a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
        if tag == "header" and not self.counts["main"]:
            boiler = True
        if not boiler and tag not in _MAIN and tag not in ("html", "body") and ("class" in a or "id" in a):
            boiler = any(map(_aside, f"{a.get('class', '')} {a.get('id', '')}".split()))
            if tag == "header" and self.counts["main"] and not self.counts["boiler"]:
                boiler = False  # an article's own header holds its title
        silent = tag in _SILENT
        self.open.append((tag, boiler, silent))
        self._count(tag, boiler, silent, 1)

    def _close(self, tag: str, stop: frozenset = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for x in reversed(self.open[i:]):
                    self._count(*x, -1)
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("a", "b", "i", "span"):
            self._close(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        self._close(tag, stop=frozenset() if tag in _BLOCK or tag in _SILENT else _BLOCK)

    def handle_data(self, data):
        c = self.counts
        if c["silent"]:
            return
        now = (c["boiler"] > 0, c["main"] > 0, c["heading"] > 0, c["item"] > 0)
        if now != self.state:
            self.flush()
            self.state = now
        self.parts.append(data)
        n = len(data) - data.count(" ")
        self.chars += n
        if c["a"]:
            self.link_chars += n


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in page order; broken markup is read as far as it goes."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after", "boiler", "main", "heading", "item", "page_has_main")


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], float)
    linked = np.array([0, *(b.linked for b in found), 0], float)
    flags = np.array([(b.boiler, b.main, b.heading, b.item) for b in found], float).reshape(n, 4)
    has_main = np.full(n, float(any(b.main for b in found)))
    return np.column_stack([words[1:-1], linked[1:-1], words[:-2], linked[:-2], words[2:], linked[2:], flags, has_main])


#: Blocks labelled by hand: the features in the order of FEATURES, then 1 for main text.
LABELLED = (
    # within an article or main element everything that isn't marked otherwise is main text, short blocks too
    (12, 0, 7, 0, 90, 0, 0, 1, 1, 0, 1, 1), (2, 0, 0, 0, 60, 0, 0, 1, 1, 0, 1, 1), (90, 0, 12, 0, 44, 0, 0, 1, 0, 0, 1, 1),
    (2, 0, 60, 0, 7, 0, 0, 1, 0, 0, 1, 1), (7, 0, 2, 0, 80, 0, 0, 1, 0, 0, 1, 1), (1, 0, 2, 0, 1, 0, 0, 1, 0, 0, 1, 1),
    (30, 0.2, 40, 0, 8, 0.9, 0, 1, 0, 0, 1, 1), (9, 0, 30, 0, 8, 0, 0, 1, 0, 1, 1, 1), (3, 0, 9, 0, 3, 0, 0, 1, 0, 1, 1, 1),
    (4, 1, 50, 0, 50, 0, 0, 1, 0, 0, 1, 1), (5, 0, 5, 1, 0, 0, 0, 1, 0, 0, 1, 1), (150, 0, 0, 0, 14, 0, 0, 1, 0, 0, 1, 1),
    (20, 0.1, 3, 1, 20, 0, 0, 1, 0, 0, 1, 1), (6, 0.5, 20, 0, 30, 0, 0, 1, 0, 0, 1, 1), (3, 0, 120, 0, 14, 0, 0, 1, 0, 0, 1, 1),
    (300, 0, 3, 0, 40, 0, 0, 1, 0, 0, 1, 1), (15, 0, 80, 0, 38, 0, 0, 1, 0, 0, 1, 1), (4, 0, 3, 0, 33, 0, 0, 1, 1, 0, 1, 1),
    (2, 0, 200, 0, 5, 1, 0, 1, 0, 0, 1, 1), (8, 0.9, 8, 0.9, 8, 0.9, 0, 1, 0, 1, 1, 1), (45, 0, 6, 1, 45, 0, 0, 1, 0, 0, 1, 1),
    (1, 1, 10, 0, 0, 0, 0, 1, 0, 0, 1, 1), (6, 0, 0, 0, 0, 0, 0, 1, 1, 0, 1, 1), (11, 0, 11, 0, 35, 0, 0, 1, 0, 0, 1, 1),
    # menus, footers, sidebars, notices, adverts and comments, wherever they stand and however long
    (1, 1, 0, 0, 1, 1, 1, 0, 0, 1, 1, 0), (3, 1, 1, 1, 8, 0, 1, 0, 0, 1, 1, 0), (8, 0, 1, 1, 12, 0, 1, 0, 0, 0, 1, 0),
    (14, 0.1, 80, 0, 0, 0, 1, 0, 0, 0, 1, 0), (60, 0, 14, 0, 40, 0, 1, 0, 0, 0, 1, 0), (35, 0, 80, 0, 70, 0, 1, 1, 0, 0, 1, 0),
    (4, 0, 30, 0, 3, 1, 1, 1, 1, 0, 1, 0), (120, 0, 5, 0, 130, 0, 1, 0, 0, 0, 0, 0), (20, 0, 2, 1, 30, 0, 1, 0, 0, 0, 0, 0),
    (2, 1, 2, 1, 2, 1, 1, 0, 0, 1, 0, 0), (40, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0), (6, 0, 40, 0, 50, 0, 1, 1, 0, 0, 1, 0),
    # beside an article
    (10, 0, 8, 0, 40, 0, 0, 0, 0, 0, 1, 0), (50, 0, 80, 0, 3, 1, 0, 0, 0, 0, 1, 0), (3, 0, 0, 0, 4, 1, 0, 0, 1, 0, 1, 0),
    (25, 0.3, 60, 0, 0, 0, 0, 0, 0, 0, 1, 0), (2, 1, 2, 1, 2, 1, 0, 0, 0, 1, 1, 0), (80, 0, 80, 0, 60, 0, 0, 0, 0, 0, 1, 0),
    (6, 0, 3, 0, 6, 0, 0, 0, 0, 0, 1, 0), (30, 0, 2, 1, 100, 0, 0, 0, 0, 0, 1, 0), (15, 0, 90, 0, 15, 0, 0, 0, 0, 1, 1, 0),
    (5, 0, 40, 0, 40, 0, 0, 0, 1, 0, 1, 0), (40, 0.1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0), (9, 0, 60, 0, 2, 0, 0, 0, 0, 0, 1, 0),
    # pages without such an element: running text, its headings and its short paragraphs
    (80, 0, 9, 0, 60, 0, 0, 0, 0, 0, 0, 1), (35, 0.1, 80, 0, 2, 0, 0, 0, 0, 0, 0, 1), (18, 0, 35, 0, 22, 0.2, 0, 0, 0, 0, 0, 1),
    (12, 0.2, 40, 0, 40, 0, 0, 0, 0, 0, 0, 1), (6, 0, 3, 1, 80, 0, 0, 0, 1, 0, 0, 1), (3, 0, 70, 0, 65, 0, 0, 0, 0, 0, 0, 1),
    (5, 0, 50, 0, 3, 0, 0, 0, 0, 0, 0, 1), (40, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), (9, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1),
    (3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), (7, 0, 6, 0, 25, 0, 0, 0, 1, 0, 0, 1), (16, 0, 16, 0, 16, 0, 0, 0, 0, 1, 0, 1),
    (2, 0, 5, 0, 8, 0, 0, 0, 0, 0, 0, 1),
    # and lists of links or linked teasers there
    (2, 1, 0, 0, 2, 1, 0, 0, 0, 1, 0, 0), (3, 1, 2, 1, 80, 0, 0, 0, 0, 1, 0, 0), (4, 0.8, 60, 0, 4, 1, 0, 0, 0, 0, 0, 0),
    (12, 0.9, 12, 0.9, 12, 0.9, 0, 0, 0, 0, 0, 0), (5, 1, 80, 0, 0, 0, 0, 0, 0, 0, 0, 0), (25, 0.7, 3, 1, 30, 0.8, 0, 0, 0, 0, 0, 0),
    (6, 0.6, 5, 1, 4, 1, 0, 0, 1, 0, 0, 0), (2, 0, 2, 1, 2, 1, 0, 0, 0, 0, 0, 0), (1, 0, 3, 1, 1, 1, 0, 0, 0, 1, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: a label, or (feature, cut, tree below or at the cut, tree above)."""
    if depth == 0 or (y == y[0]).all():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            impurity = sum(s.sum() * 2 * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def tree():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def decide(node, row) -> int:
    while not isinstance(node, int):
        f, cut, low, high = node
        node = low if row[f] <= cut else high
    return node


def main_text(html: str | None) -> str:
    """The blocks of main text in page order, joined by two line ends; empty for null or empty pages."""
    found = blocks(html or "")
    if not found:
        return ""
    root = tree()
    return "\n\n".join(b.text for b, row in zip(found, features(found).tolist(), strict=True) if decide(root, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row. Null or empty html gives empty text and 0; repeated rows are
    read one by one; nulls in other columns stay. Rows never leave their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    rows = pages.select(pages[id_col].cast("bigint").alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(run, "id bigint, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
