"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at its block-level tags into flat blocks of text. Each block has its number of words, its link density (share of words
inside links), both of these for the block before and after it, and where it stands: inside an article or main
element, inside a container that by its tag, role, class or id is not article text (menu, advert, comments...), and whether the page
marks an article at all. A decision tree over these, trained on the small labelled table below, tells the
article's blocks: containers part what the markup names, neighbours and the block itself decide on pages that mark no article and in
containers whose name may as well be a subject. Blocks without a link between two such blocks, and headings right before one, belong to
the article too. Scripts, styles, comments of the markup and form controls hold no text.

How it spreads: every page is handled by itself where it is read; nothing is shuffled.

Defined cases: NULL and empty pages give an empty text; broken markup is read leniently (unknown end tags are ignored, unclosed
elements end with their parent, an unclosed comment or script reaches to the end); repeated rows are handled alike; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base

# Tags that part blocks, hold no readable text, have no end, or enclose other things than the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea select option button head title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_TAGS = frozenset("nav aside footer form dialog menu".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar "
    "toolbar comment comments reply replies respond disqus discussion related recommended share sharing social newsletter "
    "subscribe subscription signup login search widget pagination pager copyright disclaimer skip".split()
)
#: In an article a compound name with one of these ("related-work") may name its subject; neighbours decide.
SUBJECTS = frozenset("related recommended discussion notice search social share sharing banner menu respond header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: In an article these hold its title; elsewhere they are the page's own head.
HEADS = frozenset(["header"])

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)

# The labelled table. in_article, outside (1: surely, 0.5: perhaps), page_has_article, words, link density,
# words and link density before, words and link density after, label (1: article text).
LABELLED = (
    (1, 0, 1, 9, 0.0, 6, 1.0, 40, 0.0, 1), (1, 0, 1, 60, 0.0, 9, 0.0, 45, 0.0, 1), (1, 0, 1, 3, 0.0, 50, 0.0, 44, 0.0, 1),
    (1, 0, 1, 1, 0.0, 20, 0.0, 12, 0.0, 1), (1, 0, 1, 25, 0.2, 30, 0.0, 4, 1.0, 1), (1, 0, 1, 5, 1.0, 30, 0.0, 35, 0.0, 1),
    (1, 0, 1, 120, 0.05, 80, 0.0, 6, 0.0, 1), (1, 0, 1, 12, 0.0, 0, 0.0, 0, 0.0, 1), (1, 0, 1, 2, 0.0, 1, 1.0, 1, 1.0, 1),
    (1, 0, 1, 300, 0.0, 2, 0.0, 7, 0.1, 1), (1, 0, 1, 7, 0.5, 12, 0.0, 9, 0.0, 1), (1, 0, 1, 18, 0.0, 5, 0.0, 3, 0.0, 1),
    (1, 1, 1, 30, 0.0, 60, 0.0, 20, 0.0, 0), (1, 1, 1, 4, 1.0, 50, 0.0, 3, 1.0, 0), (1, 1, 1, 80, 0.0, 70, 0.0, 12, 0.0, 0),
    (1, 1, 1, 12, 0.3, 45, 0.0, 6, 0.0, 0), (1, 1, 1, 2, 0.0, 9, 0.0, 33, 0.0, 0), (0, 1, 1, 3, 1.0, 2, 1.0, 3, 1.0, 0),
    (0, 1, 1, 40, 0.0, 5, 1.0, 9, 0.0, 0), (0, 1, 1, 9, 0.0, 50, 0.0, 0, 0.0, 0), (0, 1, 1, 150, 0.0, 30, 0.0, 20, 0.0, 0),
    (0, 0, 1, 4, 0.0, 0, 0.0, 3, 1.0, 0), (0, 0, 1, 25, 0.0, 6, 1.0, 9, 0.0, 0), (0, 0, 1, 70, 0.0, 40, 0.0, 8, 0.0, 0),
    (0, 0, 1, 8, 0.6, 3, 1.0, 4, 1.0, 0), (0, 0, 1, 2, 1.0, 2, 1.0, 12, 0.0, 0), (0, 0, 0, 45, 0.0, 8, 0.0, 50, 0.0, 1),
    (0, 0, 0, 80, 0.05, 60, 0.0, 30, 0.0, 1), (0, 0, 0, 22, 0.0, 40, 0.0, 35, 0.0, 1), (0, 0, 0, 8, 0.0, 3, 1.0, 60, 0.0, 1),
    (0, 0, 0, 5, 0.0, 40, 0.0, 55, 0.0, 1), (0, 0, 0, 30, 0.1, 3, 1.0, 2, 1.0, 1), (0, 0, 0, 3, 1.0, 2, 1.0, 3, 1.0, 0),
    (0, 0, 0, 2, 0.0, 3, 1.0, 2, 1.0, 0), (0, 0, 0, 12, 0.9, 9, 0.8, 14, 1.0, 0), (0, 0, 0, 4, 0.0, 2, 1.0, 3, 0.0, 0),
    (0, 0, 0, 6, 0.5, 40, 0.0, 0, 0.0, 0), (0, 0, 0, 3, 0.0, 5, 0.0, 2, 0.0, 0), (0, 0, 0, 40, 0.7, 20, 0.8, 30, 0.9, 0),
    (0, 0, 1, 50, 0.0, 40, 0.0, 60, 0.0, 0), (0, 0, 1, 30, 0.0, 9, 0.0, 45, 0.0, 0), (0, 0, 1, 90, 0.0, 80, 0.0, 50, 0.0, 0),
    (0, 0, 1, 12, 0.0, 2, 1.0, 40, 0.0, 0), (0, 0, 1, 33, 0.0, 30, 0.0, 70, 0.0, 0), (0, 0, 1, 6, 0.0, 0, 0.0, 80, 0.0, 0),
    (0, 0, 0, 24, 0.0, 3, 0.5, 4, 0.8, 1), (0, 0, 0, 55, 0.1, 12, 0.9, 6, 1.0, 1), (0, 0, 0, 20, 0.0, 18, 0.0, 2, 0.0, 1),
    (0, 0, 0, 27, 0.0, 2, 1.0, 28, 0.0, 1), (0, 0, 0, 27, 0.0, 30, 0.0, 2, 1.0, 1), (0, 0, 0, 35, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 0, 0, 60, 0.0, 4, 1.0, 3, 1.0, 1), (0, 0, 0, 18, 0.0, 25, 0.0, 22, 0.0, 1), (0, 0, 0, 14, 0.9, 30, 0.0, 28, 0.0, 0),
    (0, 1, 0, 40, 0.0, 30, 0.0, 50, 0.0, 0), (0, 1, 0, 4, 1.0, 3, 1.0, 5, 1.0, 0), (0, 1, 0, 90, 0.0, 80, 0.0, 60, 0.0, 0),
    # Short blocks of pages without an article: beside prose they belong to it, among links and other short ones they don't.
    (0, 0, 0, 2, 0.0, 2, 1.0, 42, 0.0, 1), (0, 0, 0, 3, 0.0, 44, 0.0, 38, 0.0, 1), (0, 0, 0, 4, 0.0, 30, 0.0, 61, 0.0, 1),
    (0, 0, 0, 2, 0.0, 51, 0.0, 2, 0.0, 1), (0, 0, 0, 3, 0.0, 36, 0.0, 5, 0.0, 1), (0, 0, 0, 9, 0.0, 8, 0.0, 33, 0.0, 1),
    (0, 0, 0, 1, 0.0, 24, 0.0, 27, 0.0, 1), (0, 0, 0, 2, 0.0, 0, 0.0, 35, 0.0, 1), (0, 0, 0, 4, 0.0, 3, 0.0, 47, 0.0, 1),
    (0, 0, 0, 8, 0.0, 1, 1.0, 9, 0.0, 0), (0, 0, 0, 10, 0.0, 1, 1.0, 7, 0.0, 0), (0, 0, 0, 3, 0.0, 2, 1.0, 0, 0.0, 0),
    (0, 0, 0, 2, 0.0, 1, 1.0, 1, 1.0, 0), (0, 0, 0, 4, 0.0, 0, 0.0, 1, 1.0, 0), (0, 0, 0, 1, 0.0, 3, 1.0, 2, 0.0, 0),
    (0, 0, 0, 5, 0.0, 2, 1.0, 3, 1.0, 0), (0, 0, 0, 9, 0.0, 3, 1.0, 4, 1.0, 0), (0, 0, 0, 6, 0.0, 1, 1.0, 5, 0.0, 0),
    # Perhaps outside, in an article: prose beside prose belongs to it, what stands among links doesn't.
    (1, 0.5, 1, 40, 0.0, 50, 0.0, 35, 0.0, 1), (1, 0.5, 1, 12, 0.0, 60, 0.0, 28, 0.0, 1), (1, 0.5, 1, 30, 0.1, 2, 0.0, 44, 0.0, 1),
    (1, 0.5, 1, 2, 0.0, 45, 0.0, 33, 0.0, 1), (1, 0.5, 1, 25, 0.0, 31, 0.0, 0, 0.0, 1), (1, 0.5, 1, 22, 0.0, 4, 0.0, 0, 0.0, 1),
    (1, 0.5, 1, 4, 1.0, 50, 0.0, 5, 1.0, 0), (1, 0.5, 1, 2, 0.0, 40, 0.0, 3, 1.0, 0), (1, 0.5, 1, 6, 0.9, 3, 1.0, 0, 0.0, 0),
    (1, 0.5, 1, 3, 0.0, 55, 0.0, 4, 0.0, 0), (1, 0.5, 1, 2, 0.0, 20, 0.0, 0, 0.0, 0), (1, 0.5, 1, 9, 0.0, 2, 1.0, 3, 1.0, 0),
    (1, 0.5, 1, 4, 0.0, 33, 0.0, 2, 0.0, 0), (1, 0.5, 1, 3, 0.0, 12, 0.0, 6, 0.0, 0),
)


def place(in_article: float, outside: float, page_has_article: float) -> int:
    """What the markup says: 0 not of the article, 1 perhaps not, 2 nothing, 3 of the article."""
    if outside >= 1 or page_has_article and not in_article:
        return 0
    return 1 if outside else 3 if in_article else 2


#: Columns of the neighbours in the tree's rows: place, words, link density, and both of these before and after, label.
NEIGHBOURS = (3, 4, 5, 6)


def table() -> list[tuple]:
    """The tree's labelled rows. Where the markup speaks, it is right about blocks of every look: all looks stand in both places."""
    looks = {r[3:-1] for r in LABELLED}
    told = [(at, *look, label) for look in sorted(looks) for at, label in ((0, 0), (3, 1))]
    return told + [(at, *r[3:]) for r in LABELLED if (at := place(*r[:3])) in (1, 2)]



@dataclass
class Split:
    """A tree node: rows with feature <= at go left; a leaf has a label."""

    label: int
    feature: int = -1
    at: float = 0.0
    left: Split | None = None
    right: Split | None = None

    def decide(self, row: tuple) -> int:
        node = self
        while node.left is not None:
            node = node.left if row[node.feature] <= node.at else node.right
        return node.label


def train(rows: list[tuple] | None = None, depth: int = 10) -> Split:
    """A decision tree by Gini impurity; of equally good splits the first feature wins."""
    known = np.array(table() if rows is None else rows, dtype=float)
    x, y = known[:, :-1], known[:, -1]
    node = Split(int(y.mean() >= 0.5))
    if depth == 0 or y.min() == y.max():
        return node
    best = (2.0 * len(y), -1, 0.0)
    for f in range(x.shape[1]):
        for at in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= at
            impurity = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if impurity < best[0] - 1e-9:
                above = x[x[:, f] > at, f].min()
                best = (impurity, f, (at + above) / 2)
    if best[1] < 0:
        return node
    node.feature, node.at = best[1], best[2]
    low = x[:, node.feature] <= node.at
    node.left, node.right = train(known[low], depth - 1), train(known[~low], depth - 1)
    return node


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    outside: float
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _named_outside(value: str, in_article: bool) -> float:
    """How surely a class or id names something else than article text."""
    found = 0.0
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        for x in OUTSIDE_WORDS.intersection(parts):
            perhaps = in_article and len(parts) > 1 and OUTSIDE_WORDS.isdisjoint(set(parts) - SUBJECTS)
            found = max(found, 0.5 if perhaps and x in SUBJECTS else 1.0)
    return found


def _stands_outside(tag: str, attributes: str, in_article: bool) -> float:
    """Whether an element encloses something else than article text: 1 surely, 0.5 perhaps."""
    if tag in OUTSIDE_TAGS or (tag in HEADS and not in_article):
        return 1.0
    found = 0.0
    for m in NAMED.finditer(attributes or ""):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and OUTSIDE_ROLES.intersection(value.split()):
            return 1.0
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            found = max(found, _named_outside(value, in_article))
            if "header" in value.split() and not in_article:
                return 1.0
        if name in ("class", "id") and tag == "article" and not {"comment", "comments", "reply", "ad", "related"}.isdisjoint(
            re.split(r"[^a-z]+", value)
        ):
            return 1.0
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 1.0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 1.0
    return found


def blocks(page: str) -> list[Block]:
    """The page's flat text blocks, in order."""
    out: list[Block] = []
    pending: list[tuple[str, bool]] = []  # text of the open block, and whether it is linked
    # Open elements as (tag, in_article, outside, silent, linked), and how many of each tag are open.
    stack = [("", False, 0.0, False, False)]
    opened: dict[str, int] = {}

    def close_block() -> None:
        if pending:
            parts = [(html.unescape(t).split(), link) for t, link in _merged(pending)]
            text = " ".join(html.unescape("".join(t for t, _ in pending)).split())
            if text:
                words = len(text.split(" "))
                linked = min(words, sum(len(w) for w, link in parts if link))
                out.append(Block(text, words, linked, stack[-1][1], stack[-1][2], stack[-1][0] in HEADINGS))
            pending.clear()

    def drop(tag: str) -> None:
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == tag:
                return

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        begin = m.start() if m else size
        if begin > at and not stack[-1][3]:
            pending.append((page[at:begin], stack[-1][4]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, ending, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in BLOCKS:
            close_block()
        if ending:
            if opened.get(tag):
                drop(tag)
            continue
        if tag in BLOCKS and opened.get("p") and stack[-1][0] == "p":
            drop("p")
        elif tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == tag:
            drop(tag)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            if tag == "br" and not stack[-1][3]:
                pending.append((" ", stack[-1][4]))
            continue
        _, in_article, outside, silent, linked = stack[-1]
        in_article = in_article or tag in ("article", "main") or (tag == "div" and "itemprop=\"articleBody\"" in attributes)
        stack.append((
            tag, in_article, max(outside, _stands_outside(tag, attributes, in_article)), silent or tag in SILENT,
            linked or tag == "a",
        ))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
    close_block()
    return out


def _merged(pending: list[tuple[str, bool]]) -> Iterator[tuple[str, bool]]:
    """Neighbouring pieces of one kind joined, so that a word cut by markup counts once."""
    text, kind = [], None
    for t, link in pending:
        if kind is not None and link != kind:
            yield "".join(text), kind
            text = []
        text.append(t)
        kind = link
    if text:
        yield "".join(text), kind


def main_text(page: str | None, tree: Split) -> tuple[str, int]:
    """The article's blocks joined by blank lines, and the number of all blocks."""
    found = blocks(page or "")
    has_article = any(b.in_article and b.outside < 1 for b in found)
    kept = []
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        after = found[i + 1] if i + 1 < len(found) else None
        row = (
            place(b.in_article, b.outside, has_article), b.words, b.density,
            before.words if before else 0, before.density if before else 0.0,
            after.words if after else 0, after.density if after else 0.0,
        )
        kept.append(bool(tree.decide(row)))
    if not has_article:
        _closed(found, kept)
    return "\n\n".join(b.text for b, k in zip(found, kept, strict=True) if k), len(found)


def _closed(found: list[Block], kept: list[bool]) -> None:
    """Keep also what the article encloses: unlinked blocks between two kept ones, and headings right before one."""
    last, open_run = None, True
    for i, b in enumerate(found):
        if kept[i]:
            if last is not None and open_run:
                kept[last:i] = [True] * (i - last)
            last, open_run = i, True
        elif b.outside or b.density > 0:
            open_run = False
    for i in range(len(found) - 2, -1, -1):
        if kept[i + 1] and found[i].heading and not found[i].outside and found[i].density < 1:
            kept[i] = True


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, the article's text, its length in characters, and the page's number of blocks."""
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(p, tree) for p in b.column("html").to_pylist()]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.small_batches(spark)
    return extract(base.table(spark, sf_dir, "pages"))
