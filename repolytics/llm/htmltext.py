"""The main text of web pages: flat text blocks, told apart by a decision tree.

A page is read once into blocks of text, without a tree of elements.  What a
block is judged by: its words and link density and those of the blocks before
and after, the hints that open elements and their names give, and its company
(other blocks in the same element).  The tree is fitted by Gini impurity on the
small labelled table of :mod:`repolytics.llm.labelled_blocks`.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType

from repolytics.llm.labelled_blocks import LABELLED, MARK, rendered

# Attributes: what follows "=" may be quoted, and quoted text may hold ">".
_ATTRIBUTES = r"""(?:[^>=]++|=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+"""
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>script|style|title|textarea|xmp|iframe|noembed|noframes)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>{_ATTRIBUTES})>"
    r"|<(?P<odd_end>/?)(?P<odd_tag>[a-z][^\s/>]*+)(?P<odd_attributes>[^>]*)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark math mfrac mi mn mo mrow ms msub msup mtext nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is none of the page's.
SILENT = frozenset("audio button canvas datalist map noscript object option select svg template video".split())
#: Elements that end an open one of these kinds.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Elements whose blocks belong with those of the element around.
_WITHIN = HEADINGS | {"p", "li", "td", "th", "dd", "dt", "tr"}

#: Hints of elements, and of words in their class, id, role or itemprop.
MAIN_TAGS, SIDE_TAGS = frozenset(("article", "main")), frozenset(("nav", "aside", "footer", "header", "form", "dialog", "menu", "fieldset"))
MAIN_WORDS = frozenset("article articlebody content contents entry main post prose story".split())
SIDE_WORDS = frozenset(
    """ad ads adsense adv advert advertisement advertising alert aside banner bottombar breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies
    copyright dialog disclaimer discussion disqus feedback footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice notification
    overlay pager pagination paywall popular popup promo promotion promoted recommended related replies reply respond search share sharing sidebar signin signup social
    sponsor sponsored subscribe subscription teaser toolbar topbar trending upsell widget widgets""".split()
)
#: Words by which an element only says what its page has.
_ABOUT = frozenset(("has", "with", "no", "without", "layout", "wrapper"))

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "hint", "side_outside", "in_main", "page_has_main", "heading", "paragraph", "item", "sentence", "company", "company_links", "company_share", "wide_words", "wide_links", "wide_share")


@dataclass(slots=True)
class Block:
    """A run of text between block-level tags."""

    text: str
    words: int
    linked: int
    tag: str
    hint: int
    side_outside: bool
    in_main: bool
    home: int
    wide: int
    marked: bool


@dataclass(slots=True)
class _Open:
    """An open element: what it and those around it say about the text in it."""

    tag: str
    hint: int
    side_outside: bool
    in_main: bool
    home: int
    wide: int
    marked: bool


def hint_of(tag: str, attributes: str, in_main: bool) -> int:
    """1 if an element looks like the main text's, -1 if like other matter, 0 if it doesn't say."""
    if tag in ("body", "html"):
        return 0
    if _HIDDEN.search(attributes):
        return -1
    words = {w.lower() for names in _NAMES.findall(attributes) for w in _WORD.findall("".join(names))}
    if "-" in tag:
        words.update(tag.split("-"))
    heads = "header" in words or tag == "header"
    side, main = not words.isdisjoint(SIDE_WORDS), not words.isdisjoint(MAIN_WORDS) or tag in MAIN_TAGS
    if words & _ABOUT and tag not in SIDE_TAGS:
        return 1 if tag in MAIN_TAGS else 0
    if side or tag in SIDE_TAGS and tag != "header":
        return -1
    if heads:  # of the page, unless the article's own
        return 0 if in_main or main else -1
    return 1 if main else 0


def _measure(text: str) -> int:
    """Words; scripts without spaces count eight characters as one."""
    return max(text.count(" ") + 1, len(text) // 8)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, empty ones left out.  Takes time in proportion to the page."""
    found: list[Block] = []
    stack = [_Open("", 0, False, False, 0, 0, False)]
    depth: Counter[str] = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    silent, number, link_depth = 0, 0, 0

    def flush() -> None:
        if not pieces:
            return
        text = " ".join("".join(pieces).split())
        pieces.clear()
        links = " ".join("".join(linked).split())
        linked.clear()
        if text:
            top = stack[-1]
            words = _measure(text)
            found.append(Block(text, words, min(words, _measure(links)) if links else 0, top.tag, top.hint, top.side_outside, top.in_main, top.home, top.wide, top.marked))

    def close(tag: str) -> None:
        nonlocal silent, link_depth
        while True:
            gone = stack.pop()
            depth[gone.tag] -= 1
            silent -= gone.tag in SILENT
            if gone.tag == tag:
                break
        if link_depth > len(stack):
            link_depth = 0

    def say(text: str) -> None:
        if silent or not text:
            return
        text = html.unescape(text) if "&" in text else text
        pieces.append(text)
        if link_depth:
            linked.append(text)

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["odd_tag"]
        if not tag:
            if m["raw"] and m["raw"].lower() not in INLINE:
                pieces.append(" ")
            continue
        tag, ending, attributes = tag.lower(), m["end"] or m["odd_end"], m["attributes"] or m["odd_attributes"] or ""
        if tag == "a":
            link_depth = 0 if ending else len(stack)
            linked.append(" ")
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in INLINE:
            continue
        if tag in SILENT:
            pieces.append(" ")
        else:
            flush()
        if ending:
            if depth[tag]:
                close(tag)
            continue
        while stack[-1].tag == "p" and tag not in SILENT or stack[-1].tag in ENDS.get(tag, ()):
            close(stack[-1].tag)
        if tag in VOID or attributes.endswith("/") and tag in SILENT:
            continue
        top = stack[-1]
        hint = hint_of(tag, attributes, top.in_main)
        number += 1
        depth[tag] += 1
        silent += tag in SILENT
        side = top.side_outside or hint < 0 and tag not in ("form", "fieldset")
        home, wide = (top.home, top.wide) if tag in _WITHIN else (number, top.home)
        stack.append(_Open(tag, hint or top.hint, side, top.in_main or hint > 0, home, wide, top.marked or MARK in attributes))
    say(page[at:])
    flush()
    return found


def _company(homes: list[int], words: np.ndarray, linked: np.ndarray, plain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean words and link density of the other blocks at home, and the home's share of the page's unlinked words."""
    _, home = np.unique(np.array(homes, int), return_inverse=True)
    count, all_words, all_linked = (np.bincount(home, w)[home] if len(home) else words for w in (None, words, linked))
    rest = all_words - words
    return rest / np.maximum(count - 1, 1), (all_linked - linked) / np.maximum(rest, 1), (all_words - all_linked) / plain


def features_of(blocks: list[Block]) -> np.ndarray:
    """A row for each block of a page: see ``FEATURES``."""
    n = len(blocks)
    words = np.array([b.words for b in blocks], float)
    linked = np.array([b.linked for b in blocks], float)
    links = linked / np.maximum(words, 1)
    plain = max(float((words - linked).sum()), 1.0)
    near, wide = ([b.home for b in blocks], [b.wide for b in blocks])
    page_has_main = float(any(b.in_main and not b.side_outside for b in blocks))
    zero = np.zeros(1)
    columns = [
        words, links, np.r_[zero, words[:-1]][:n], np.r_[zero, links[:-1]][:n], np.r_[words[1:], zero][:n], np.r_[links[1:], zero][:n],
        np.array([b.hint for b in blocks], float), np.array([b.side_outside for b in blocks], float), np.array([b.in_main for b in blocks], float), np.full(n, page_has_main),
        np.array([b.tag in HEADINGS for b in blocks], float), np.array([b.tag == "p" for b in blocks], float), np.array([b.tag in ("li", "td", "dd", "dt") for b in blocks], float),
        np.array([b.text[-1] in ".!?…。！？\"'”»)" for b in blocks], float), *_company(near, words, linked, plain), *_company(wide, words, linked, plain),
    ]
    return np.stack(columns, 1) if n else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Tree:
    """A binary tree in arrays: a node's feature (-1: a leaf), threshold, children and share of label 1."""

    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    share: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """The share of label 1 in each row's leaf."""
        at = np.zeros(len(rows), int)
        while (inner := self.feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            node = at[i]
            at[i] = self.children[node, (rows[i, self.feature[node]] > self.threshold[node]).astype(int)]
        return self.share[at]


def fit_tree(rows: np.ndarray, labels: np.ndarray, *, most_depth: int = 8, least: int = 2) -> Tree:
    """Split by the largest fall in Gini impurity, the first feature and threshold of equals, while leaves hold ``least`` rows."""
    nodes: list[list] = []

    def grow(of: np.ndarray, depth: int) -> int:
        at, y = len(nodes), labels[of]
        nodes.append([-1, 0.0, 0, 0, float(y.mean())])
        if depth == most_depth or y.min() == y.max():
            return at
        best = (1e-12, 0, 0.0)
        base = y.mean() * (1 - y.mean()) * len(y)
        for f in range(rows.shape[1]):
            order = np.argsort(rows[of, f], kind="stable")
            x, ones = rows[of[order], f], np.cumsum(y[order])
            left = np.arange(1, len(y))
            right = len(y) - left
            cost = ones[:-1] * (left - ones[:-1]) / left + (ones[-1] - ones[:-1]) * (right - (ones[-1] - ones[:-1])) / right
            fall = np.where((x[1:] > x[:-1]) & (left >= least) & (right >= least), base - cost, -1)
            i = int(fall.argmax()) if len(fall) else 0
            if len(fall) and fall[i] > best[0] + 1e-9:
                best = (float(fall[i]), f, float((x[i] + x[i + 1]) / 2))
        if best[0] <= 1e-12:
            return at
        low = rows[of, best[1]] <= best[2]
        nodes[at][:4] = [best[1], best[2], grow(of[low], depth + 1), grow(of[~low], depth + 1)]
        return at

    grow(np.arange(len(rows)), 0)
    table = np.array(nodes, float)
    return Tree(table[:, 0].astype(int), table[:, 1], table[:, 2:4].astype(int), table[:, 4])


def labelled_rows(table: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of a labelled table."""
    pages = [blocks_of(p) for p in rendered(table)]
    return np.concatenate([features_of(p) for p in pages]), np.array([b.marked for p in pages for b in p], float)


@cache
def learned(table: str = LABELLED) -> Tree:
    """The tree of a labelled table."""
    return fit_tree(*labelled_rows(table))


def judged(page: str, tree: Tree) -> tuple[list[Block], np.ndarray]:
    """A page's blocks and how likely each is main text."""
    blocks = blocks_of(page)
    return blocks, tree.predict(features_of(blocks))


_BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), ("words", pa.int64()), ("linked", pa.int64()), ("tag", pa.string()), ("score", pa.float64()), ("main", pa.bool_())]))


def main_text(page: Column, tree: Tree | None = None) -> Column:
    """The main blocks of a page, one a line; empty if there are none or the page is null."""
    model = tree or learned()

    def texts(pages: pa.Array) -> pa.Array:
        out = []
        for p in pages:
            blocks, score = judged(p.as_py(), model) if p.is_valid else ([], ())
            out.append("\n".join(b.text for b, s in zip(blocks, score, strict=True) if s >= 0.5))
        return pa.array(out, pa.string())

    texts.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(texts, StringType())(page)


def page_blocks(pages: DataFrame, *, page_id: str = "page_id", page: str = "html", tree: Tree | None = None) -> DataFrame:
    """``page_id, place, text, words, linked, tag, score, main``: every block of every page, from place 0.

    Null and empty pages, and pages without text, have no blocks.
    """
    model = tree or learned()

    def blocks(rows: pa.Array) -> pa.Array:
        found = (judged(p.as_py(), model) if p.is_valid else ([], ()) for p in rows)
        return pa.array([[{"text": b.text, "words": b.words, "linked": b.linked, "tag": b.tag, "score": float(s), "main": bool(s >= 0.5)} for b, s in zip(*f, strict=True)] for f in found], _BLOCK_TYPE)

    blocks.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    rows = pages.select(F.col(page_id).alias("_id"), F.arrow_udf(blocks, from_arrow_type(_BLOCK_TYPE))(F.col(page)).alias("_blocks"))
    return rows.select(F.col("_id").alias(page_id), F.posexplode("_blocks").alias("place", "_block")).select(page_id, "place", "_block.*")


def extraction_report(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Null and empty pages have an empty text of 0 characters, null urls stay null,
    repeated rows are each extracted, and no rows give no rows.  Unclosed tags,
    comments and quotes end where a browser ends them, an unclosed quote at the
    tag's end.  Columns of other names aren't read.
    """
    rows = pages.select("page_id", "url", main_text(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
