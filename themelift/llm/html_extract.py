"""Main text of web pages by tag-path ratios.

A page is read into blocks: stretches of text between block-level tags, each with the path of tags
from the root. For every path, text length, punctuation, link text and the number of its blocks are
added up; their ratios are smoothed over neighbouring blocks in page order and fused into one number
a path. Article and main parts multiply it by a bonus, parts that are none by their tag or role
(menus, headers, footers, sidebars, forms) by 0, and a listed word in a class or id lowers it; no
block goes before the numbers are compared. Paths whose number reaches a quarter of the best are
content. In the content root of such paths (the outermost article or main part, else the nearest
path above them all) blocks between them are content as well, unless they are links and stand in no
list, table or definition of an article, and headings before, and blocks before and after that reach
a twentieth (leads). Lists, tables, definitions and code that end an article belong to it too; a line
of copyright outside of articles does not.
Text of inline parts that are none of the article (buttons, labels, hidden parts, adverts) is cut
out of its block.

Pages are independent; a task holds one page's blocks at a time.

Defined results: a null or empty html has an empty text; so has a page without text outside such
parts. Tags that are never closed or closed twice are read as browsers do in the common cases;
text outside any tag belongs to the root. Repeated rows have a row each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelift.llm.common import tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe".split())  # text up to the end tag
SKIPPED = frozenset("svg select template".split())  # elements whose text is none of the page
ENDED = {"svg", "math", "select"}  # by the start of a block, if never closed
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body caption head html legend summary tbody td tfoot th thead title tr".split())
#: A start tag ends an open element of these names, unless an element of the second list is nearer.
ENDS_OPEN = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "table tr"),
    "th": ("td th", "table tr"),
    "tbody": ("tbody thead tfoot tr td th", "table"),
    "thead": ("tbody thead tfoot tr td th", "table"),
    "tfoot": ("tbody thead tfoot tr td th", "table"),
    "option": ("option", "select"),
    "body": ("head", "html"),
}
SCOPES = frozenset("html table td th caption button object article section div main aside nav header footer form body blockquote li dd figure template".split())

NOT_ARTICLE_TAGS = frozenset("head nav aside footer form button dialog menu search fieldset label input svg select template".split())
NOT_ARTICLE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)
NOT_ARTICLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner cookie "
    "cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "sidebar aside widget widgets nav navbar navigation menu menus topbar breadcrumb breadcrumbs pagination pager "
    "masthead footer foot comment comments commentlist disqus respond reply replies share sharing social related "
    "recommended recommendations login signin search toolbar skip copyright disclaimer tracking hidden".split()
)
HEADER_WORDS = frozenset("header head top".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts that stand for themselves: of a listed word only a whole class or id lowers their number.
TEXT_PARTS = HEADINGS | frozenset("p blockquote figure figcaption pre li dl dt dd table td th tr caption".split())
ENDINGS = frozenset("li dt dd td th pre caption figcaption".split())  # parts that may end an article
LEGAL = re.compile(r"(?i)^\W*(?:\(c\)\s*\d|©|copyright\s*(?:©|\(c\)|\d)|all rights reserved\W*$)")
CONTENT_TAGS = {"article": 8.0, "main": 8.0}
CONTENT_WORDS = frozenset("article content main post entry story body text".split())
ROOT_WEIGHT = 6.0
#: Factors of content parts with a listed word: as a whole class or id, and as a piece of one
#: (has-sidebar, widget-text).
LISTED, PARTLY = 0.1, 0.5
THRESHOLD = 0.25  # of the best path's number
WEAK = 0.05  # the same for blocks next to the content in its root
SMOOTHING = (0.25, 0.5, 0.25)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


@dataclass
class Element:
    """An open element, with what it has from the elements around it."""

    name: str
    path: int  # number of the path of block tags down to it
    root: int  # number of the path of the outermost content root it is in, -1: none
    weight: float  # the best of the roots it is in, 1: none, 0: no part of an article
    link: bool
    inside: bool  # an article or main part
    heading: bool
    skipped: bool
    article: int  # number of the path of the innermost article or main part, -1: none
    ending: bool  # in a list, table, definition or code
    factor: float  # of all listed words down to it
    stems: frozenset[str]  # beginnings of classes up to a listed word, of content parts


@dataclass
class Block:
    path: int
    root: int
    weight: float
    text: str
    links: int
    heading: bool
    article: int
    ending: bool
    factor: float


OUTSIDE = Element("", 0, -1, 1.0, False, False, False, False, -1, False, 1.0, frozenset())


def listed(names: str) -> frozenset[str]:
    """Each class or id up to a listed word in it."""
    return frozenset(
        token[: part.end()].lower() for token in names.split() for part in WORD.finditer(token) if part[0].lower() in NOT_ARTICLE_WORDS
    )


def element(name: str, attributes: str, around: Element, paths: dict[tuple[int, str], int]) -> Element:
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in WORD.findall(names)}
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    weight = 1.0
    if name in NOT_ARTICLE_TAGS or role in NOT_ARTICLE_ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        weight = 0.0
    elif "display:none" in style or "visibility:hidden" in style:
        weight = 0.0
    elif name == "header" or name in ("div", "section") and words & HEADER_WORDS:
        weight = 1.0 if around.inside else 0.0
    elif name in CONTENT_TAGS:
        weight = CONTENT_TAGS[name]
    elif role in ("main", "article") or found.get("itemprop") == "articleBody":
        weight = CONTENT_TAGS["main"]
    elif name in ("div", "section", "td") and words & CONTENT_WORDS:
        weight = ROOT_WEIGHT
    factor, stems = around.factor, around.stems
    if weight > 0.0 and name not in ("html", "body", "main") and words & NOT_ARTICLE_WORDS:
        new = listed(names) - stems
        if new and weight > 1.0:
            whole = any(token.lower() in NOT_ARTICLE_WORDS for token in names.split())
            factor, stems = factor * (LISTED if whole else PARTLY), stems | new
        elif name in TEXT_PARTS:
            factor *= PARTLY if new & set(names.lower().split()) else 1.0
        elif name not in BLOCKS and new & set(names.lower().split()):
            weight = 0.0
        elif new and name in BLOCKS:
            factor *= LISTED
    path, root, best = around.path, around.root, around.weight
    if name in BLOCKS:
        label = name + "".join(f".{w}" for w in names.lower().split())
        path = paths.setdefault((path, label), len(paths) + 1)
    if weight == 0.0 or best == 0.0:
        best = 0.0
    elif weight > 1.0:
        root, best = path if root < 0 else root, max(best, weight)
    skipped = around.skipped or name in SKIPPED or (best == 0.0 and name not in BLOCKS)
    article = path if weight >= CONTENT_TAGS["main"] else around.article
    return Element(
        name, path, root, best, around.link or name == "a", around.inside or name in CONTENT_TAGS,
        around.heading or name in HEADINGS, skipped, article, around.ending or name in ENDINGS, factor, stems,
    )


def close(open_: list[Element], names: set[str], scope: frozenset[str]) -> None:
    """End the innermost element of these names and all inside it, if none of the scope is nearer."""
    for at in range(len(open_) - 1, -1, -1):
        if open_[at].name in names:
            del open_[at:]
            return
        if open_[at].name in scope:
            return


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page in its order, without those that have no text; and of each path the
    number of the path above it."""
    out: list[Block] = []
    open_: list[Element] = []
    paths: dict[tuple[int, str], int] = {}
    parts: list[str] = []
    links = at = 0

    def skips() -> bool:
        return bool(open_) and open_[-1].skipped

    def end_block() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            now = next((e for e in reversed(open_) if not e.skipped), OUTSIDE)
            out.append(Block(now.path, now.root, now.weight * now.factor, text, links, now.heading, now.article, now.ending, now.factor))
        parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not skips():
            text = html.unescape(raw)
            parts.append(text)
            if open_ and open_[-1].link:
                links += len(text.strip())

    while found := TAG.search(page, at):
        add(page[at : found.start()])
        at = found.end()
        ends, name, attributes = (found[k] or found[k + 3] or "" for k in (1, 2, 3))
        name = name.lower()
        if not name:
            if found[0].startswith("<![CDATA[") and not skips():
                parts.append(found[0][9:].removesuffix("]]>"))
            continue
        if name in BLOCKS:
            end_block()
        elif name == "br":
            parts.append(" ")
        if ends:
            scope = frozenset() if name in BLOCKS and name != "p" else SCOPES
            if name not in ("html", "body"):
                close(open_, {name}, scope)
            continue
        if name in ENDS_P:
            close(open_, ENDED, SCOPES | {"foreignobject"})
            close(open_, {"p"}, SCOPES)
        if name in ENDS_OPEN:
            names, scope = ENDS_OPEN[name]
            close(open_, set(names.split()), frozenset(scope.split()))
        if name in RAW and not (attributes.endswith("/") and skips()):
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else len(page)
        elif name not in VOID and not (attributes.endswith("/") and name not in BLOCKS):
            open_.append(element(name, attributes, open_[-1] if open_ else OUTSIDE, paths))
    add(page[at:])
    end_block()
    return out, [0, *(above for above, _ in paths)]


def ratios(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """The fused number of each block's path: text and punctuation a block, smoothed over the page
    and lowered by the share of link text; and that share."""
    at: dict[int, int] = {}
    which = np.array([at.setdefault(b.path, len(at)) for b in found])
    text = np.array([len(b.text) for b in found], float)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in found], float)
    links = np.array([b.links for b in found], float)
    many = np.bincount(which)

    def smoothed(values: np.ndarray) -> np.ndarray:
        each = (np.bincount(which, values) / many)[which]
        return np.convolve(np.pad(each, 1, mode="edge"), SMOOTHING, "valid")

    share = np.minimum(np.bincount(which, links) / np.bincount(which, text), 1.0)[which]
    fused = np.sqrt(smoothed(text)) * (1.0 + smoothed(marks)) * (1.0 - share)
    return (np.bincount(which, fused) / many)[which], share


def inside_common(found: list[Block], chosen: np.ndarray, parents: list[int]) -> np.ndarray:
    """Which blocks lie in the nearest path around all chosen ones; a path has a larger number than
    those above it."""
    below = [0] * len(parents)
    for at in np.flatnonzero(chosen).tolist():
        below[parents[found[at].path]] += 1
    top, total = 0, sum(below)
    for path in range(len(parents) - 1, 0, -1):
        if below[path] == total:
            top = path
            break
        below[parents[path]] += below[path]
    held = [path == top for path in range(len(parents))]
    for path in range(1, len(parents)):
        held[path] = held[path] or held[parents[path]]
    return np.array([held[b.path] for b in found])


def selected(found: list[Block], parents: list[int]) -> np.ndarray:
    """Which blocks are the content."""
    fused, share = ratios(found)
    weights = np.array([b.weight for b in found])
    numbers = fused * weights
    legal = np.array([b.article < 0 and LEGAL.match(b.text) is not None for b in found])
    strong = (numbers >= THRESHOLD * numbers.max()) & (weights > 0) & ~legal
    if not strong.any():
        return strong
    factors = np.array([b.factor for b in found])
    clean = (factors > LISTED * factors[strong].max()) & (weights > 0) & ~legal
    article = np.array([b.article for b in found])
    own = article >= 0
    headings, endings = (np.array([getattr(b, name) for b in found]) for name in ("heading", "ending"))
    joins = clean & ((own & endings) | (share < 0.5))
    weak = (numbers >= WEAK * numbers.max()) & (share < 0.5) & clean
    before = weak | (headings & (share < 0.5) & clean)
    roots, keep = np.array([b.root for b in found]), strong.copy()
    for root in np.unique(roots[strong]).tolist():
        here = roots == root
        if root < 0:
            here &= inside_common(found, strong & here, parents)
        at = np.flatnonzero(here & (clean | strong))
        sure = np.flatnonzero(strong[at])
        first, last = int(sure[0]), int(sure[-1])
        keep[at[first : last + 1]] |= joins[at[first : last + 1]]
        while first > 0 and before[at[first - 1]]:
            first -= 1
        ends = endings & own & (article == article[at[last]])
        end = last
        while end + 1 < len(at) and (weak | ends | headings)[at[end + 1]]:
            end += 1
            if (weak | ends)[at[end]]:  # a heading alone ends nothing
                last = end
        keep[at[first : sure[0]]] = True
        keep[at[sure[-1] : last + 1]] = True
    return keep


def main_text(page: str) -> str:
    """The blocks that are content, one a line."""
    found, parents = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, selected(found, parents), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                texts = [main_text(page or "") for page in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
