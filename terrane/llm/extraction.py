"""HTML extraction: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. Each block is
described by its words and link density, those of the blocks before and after,
and what is around it. A decision tree trained on a small labelled table
(`labelled_blocks`) tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm import labelled_blocks

#: Comments, tags (quoted values may hold `>`), tags with a stray quote, and what is cut off at the page's end.
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*\Z""",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?i:\b(class|id|role|hidden|aria-hidden|style)\b)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Fixed values. Elements whose content is no text of the page.
_SKIP = frozenset("script style title textarea template noscript iframe svg math object canvas audio video noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_FURNITURE = frozenset("nav footer aside form menu dialog button select option search fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HINTS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment commentlist comments consent contentinfo cookie cookies "
    "copyright discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay paging pagination "
    "paywall popup promo promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget alert".split()
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    furniture: bool
    hint: bool
    heading: bool


def _hinted(attributes: str) -> tuple[bool, bool, bool]:
    """Whether names on the element tell page furniture; whether it is hidden; whether its role is main."""
    hint = hidden = main = False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name in ("hidden", "aria-hidden"):
            hidden |= value != "false"
        else:
            found = _SPLIT.split(value)
            main |= name == "role" and "main" in found
            hint |= not _HINTS.isdisjoint(found)
    return hint, hidden, main


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in order; blocks without text are left out.

    A name on an element around a main element is no hint for what is inside;
    nor is one around an article, unless the page has an article outside such
    names, beside which it is a comment or a teaser.
    """
    out: list[Block] = []
    around: list[bool] = []
    parts: list[str] = []
    linked: list[str] = []
    # open elements: name, in an article, in furniture, under a hint, under a name around the article
    stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]
    links = heading = 0

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, article, furniture, hint, outer = stack[-1]
            around.append(outer)
            out.append(Block(text, len(text.split()), len(html.unescape("".join(linked)).split()), article, furniture, hint, heading > 0))
        parts, linked = [], []

    def add(text: str) -> None:
        parts.append(text)
        if links:
            linked.append(text)

    def shut(name: str, until: frozenset[str] = frozenset()) -> None:
        nonlocal links, heading
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                for gone in stack[k:]:
                    links -= gone[0] == "a"
                    heading -= gone[0] in _HEADINGS
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    at = 0
    while found := _MARKUP.search(page, at):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        name, ending, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if name in _BLOCK:
            close()
        elif name == "br":
            add(" ")
        if ending:
            shut(name)
            continue
        if name in _SKIP:
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                at = end.start() if end else len(page)
                if end:
                    stack.append((name, *stack[-1][1:]))
            continue
        if name in _VOID:
            continue
        if name in _BLOCK:  # a paragraph ends where another block begins
            shut("p", frozenset({"button", "td", "th", "table"}))
            if name == "li":
                shut("li", frozenset({"ul", "ol", "menu"}))
        named, hidden, main = _hinted(attributes) if attributes else (False, False, False)
        _, article, furniture, under, outer = stack[-1]
        if name in ("body", "html", "main") or (name == "article" and not under):
            named, hidden = False, (named or hidden) and "hidden" in attributes.lower()  # names of the whole page tell nothing of its parts
        if not article and (main or name == "main"):
            named = outer = False
        elif not article:
            named, outer = False, outer or named
        article |= main or name in ("article", "main")
        furniture |= name in _FURNITURE or (name == "header" and not article)
        stack.append((name, article, furniture, under or named or hidden, outer))
        links += name == "a"
        heading += name in _HEADINGS
    add(page[at:])
    close()
    clear = any(b.article and not (b.furniture or b.hint or o) for b, o in zip(out, around, strict=True))
    for b, o in zip(out, around, strict=True):
        b.hint |= o and (clear or not b.article)
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "article", "page_article", "furniture", "hint", "heading")


def features(words: np.ndarray, linked: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each block of a page; flags are article, page has one, furniture, hint, heading."""
    density = np.minimum(linked / np.maximum(words, 1), 1.0)
    near = lambda x: (np.append(0, x[:-1]), np.append(x[1:], 0))
    (before, after), (links_before, links_after) = near(words), near(density)
    return np.column_stack([words, density, before, links_before, after, links_after, flags]).astype(float)


@dataclass(frozen=True)
class Tree:
    """A binary decision tree: rows with feature[k] <= limit[k] go to left[k], others to right[k]; feature -1 is a leaf."""

    feature: tuple[int, ...]
    limit: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[bool, ...]

    def predict(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        feature, limit, left, right = map(np.array, (self.feature, self.limit, self.left, self.right))
        while len(open_ := np.flatnonzero(feature[at] >= 0)):
            k = at[open_]
            at[open_] = np.where(rows[open_, feature[k]] <= limit[k], left[k], right[k])
        return np.array(self.value)[at]


def train(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 2) -> Tree:
    """Gini splits; of equal splits the first feature's lowest limit."""
    feature, limit, left, right, value = [], [], [], [], []

    def gini(yes, n):
        share = yes / n
        return n * 2 * share * (1 - share)

    def grow(some: np.ndarray, depth: int) -> int:
        k = len(feature)
        own = labels[some]
        for column, x in ((feature, -1), (limit, 0.0), (left, 0), (right, 0), (value, bool(2 * own.sum() >= len(own)))):
            column.append(x)
        if not depth or own.all() or not own.any():
            return k
        best = (gini(own.sum(), len(own)) - 1e-9, -1, 0.0)
        for f in range(rows.shape[1]):
            order = np.argsort(rows[some, f], kind="stable")
            x, y = rows[some, f][order], own[order]
            n = np.arange(1, len(x))
            yes = np.cumsum(y)[:-1]
            score = gini(yes, n) + gini(y.sum() - yes, len(x) - n)
            score[(x[1:] == x[:-1]) | (n < least) | (len(x) - n < least)] = np.inf
            if len(score) and score.min() < best[0]:
                at = int(score.argmin())
                best = (score[at], f, (x[at] + x[at + 1]) / 2)
        if best[1] >= 0:
            low = rows[some, best[1]] <= best[2]
            feature[k], limit[k] = best[1], best[2]
            left[k], right[k] = grow(some[low], depth - 1), grow(some[~low], depth - 1)
        return k

    grow(np.arange(len(rows)), depth)
    return Tree(tuple(feature), tuple(limit), tuple(left), tuple(right), tuple(value))


def labelled() -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of each labelled page."""
    out = []
    for page in labelled_blocks.TABLE.strip().split("\n\n"):
        rows = [x.split() for x in page.split("\n")]
        keep, words, links = (np.array([int(r[k]) for r in rows]) for k in range(3))
        flags = np.array([[x in r[3] for x in "apcht"] for r in rows])
        out.append((features(words, links, flags), keep.astype(bool)))
    return out


@cache
def classifier() -> Tree:
    pages = labelled()
    return train(np.concatenate([x for x, _ in pages]), np.concatenate([y for _, y in pages]))


def main_text(page: str | None, tree: Tree) -> str:
    """Main blocks of a page in order, joined by line feeds; empty for null and where there is none."""
    found = blocks(page) if page else []
    if not found:
        return ""
    has = any(b.article for b in found)
    flags = np.array([[b.article, has, b.furniture, b.hint, b.heading] for b in found])
    keep = tree.predict(features(np.array([b.words for b in found]), np.array([b.linked for b in found]), flags))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None, tree: Tree | None = None) -> DataFrame:
    """Add `text`, the main text of the whole html, to every row; a column of that name in the input is replaced.

    One row out for each row in; repeated rows alike. A null or empty page, and
    one without main text, has the empty text. No shuffle; a page at a time is
    held beside its Arrow batch.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*[f"`{c}`" for c in keep]).schema), "text string"])
    model = tree or classifier()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column("__terrane_html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, type=pa.string())], names=[*keep, "text"])

    return pages.selectExpr(*[f"`{c}`" for c in keep], f"`{html_column}` as __terrane_html").mapInArrow(run, schema)
