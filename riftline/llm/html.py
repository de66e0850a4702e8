"""Main text of web pages: flat text blocks, classified by a decision tree on the words and link density of a block and of its neighbours.

Blocks in elements that are no part of an article by their very name (nav, page header, footer, aside, form, hidden parts, and classes that
name adverts, notices, sidebars, menus or reader comments) are left out first, and where a page marks its article, so is what lies outside it.
All other blocks are the tree's: it knows no tags and no classes, and was grown on pages labelled by hand.
"""

from __future__ import annotations

import collections
import functools
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm.common import table
from riftline.llm.tree import grow, judge

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "object", "canvas", "math"}
_INLINE = {"a", "b", "i", "u", "s", "em", "strong", "span", "small", "big", "sub", "sup", "code", "kbd", "mark", "q", "abbr", "cite", "font", "time", "br", "wbr", "img", "del", "ins", "dfn", "var", "samp", "bdi", "bdo", "tt", "data", "ruby", "rt", "rp", "acronym", "strike"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_PARAGRAPHS = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6"}
_BOILER = {"nav", "footer", "aside", "form", "menu", "head", "dialog", "select", "button", "fieldset"}
#: Parts of class names and ids of what is no article, wherever it stands.
_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|side-?bar|menu|nav(?:bar|igation)?|breadcrumbs?|cookies?|consent|notice|newsletter|subscribe|comments?|disqus|repl(?:y|ies)|share|sharing|social|related|recommend\w*|widget|pag(?:er|ination)|skip)(?:$|[\s_-])", re.I)
#: Class names and ids of what frames a page; within an article they may frame a section of it.
_FRAME = re.compile(r"(?:^|\s)(?:(?:site|page|top|global|main)[_-]?)?(?:header|masthead|foot(?:er)?|banner|alert|popup|modal|overlay|signup|login|search|toolbar)(?:$|\s)", re.I)
_ATTRIBUTES = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog"}
_WHITE = re.compile(r"\s+")

#: What the tree knows of a block: its words and link density, and those of the blocks before and after; zeros where there is none.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after")
#: Pages labelled by hand: for each block its words, its share of linked words, and 1 for main text.
LABELLED = (
    ((1, 1.0, 0), (1, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (9, 0.0, 1), (80, 0.0, 1), (45, 0.05, 1), (3, 0.0, 1), (120, 0.0, 1)),
    ((7, 0.0, 1), (19, 0.0, 1), (19, 0.0, 1), (19, 0.0, 1), (19, 0.0, 1), (19, 0.0, 1)),
    ((4, 0.0, 1), (5, 0.0, 1), (4, 0.0, 1)),
    ((2, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (6, 0.0, 1), (60, 0.1, 1), (35, 0.3, 1), (2, 0.0, 1), (70, 0.0, 1), (3, 1.0, 0), (4, 1.0, 0), (3, 1.0, 0)),
    ((5, 0.8, 0), (11, 0.0, 1), (4, 0.25, 1), (150, 0.02, 1), (90, 0.0, 1), (8, 1.0, 0), (9, 1.0, 0), (7, 1.0, 0), (2, 1.0, 0)),
    ((1, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (30, 0.0, 1)),
    ((300, 0.01, 1), (1, 0.0, 1), (250, 0.0, 1), (2, 1.0, 0), (2, 1.0, 0)),
    ((8, 0.0, 1), (25, 0.4, 1), (6, 0.5, 1), (40, 0.2, 1), (12, 0.0, 1)),
    ((6, 0.67, 0), (3, 1.0, 0), (10, 0.0, 1), (2, 0.0, 1), (2, 0.0, 1), (200, 0.0, 1)),
    ((12, 0.9, 0), (14, 0.85, 0), (10, 1.0, 0), (7, 0.0, 1), (50, 0.0, 1), (16, 0.9, 0), (20, 0.95, 0)),
    ((3, 0.0, 1), (60, 0.0, 1), (4, 0.0, 1), (80, 0.15, 1), (5, 0.0, 1), (1, 0.0, 1)),
    ((2, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (13, 0.0, 1), (22, 0.45, 1), (31, 0.0, 1), (5, 1.0, 0)),
    ((1, 0.0, 0), (1, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (8, 0.0, 1), (55, 0.0, 1), (5, 1.0, 1), (70, 0.0, 1), (40, 0.1, 1), (2, 0.0, 0), (7, 1.0, 0), (9, 1.0, 0)),
    ((1, 1.0, 0), (1, 0.0, 0), (1, 1.0, 0), (1, 0.0, 0), (2, 1.0, 0), (10, 0.0, 1), (90, 0.0, 1), (3, 1.0, 1), (65, 0.05, 1)),
    ((1, 1.0, 0), (1, 0.0, 0), (2, 1.0, 0), (6, 0.0, 1), (33, 0.0, 1), (6, 0.9, 1), (48, 0.0, 1), (2, 0.0, 0), (10, 1.0, 0), (8, 0.9, 0)),
    ((2, 0.0, 0), (1, 1.0, 0), (1, 1.0, 0), (9, 0.0, 1), (28, 0.0, 1), (2, 1.0, 1), (52, 0.0, 1), (110, 0.0, 1), (4, 0.0, 1)),
)


def rows_of(page) -> list[tuple[float, ...]]:
    """FEATURES of each block of a page of (words, links, ...)."""
    around = [(0, 0.0), *(b[:2] for b in page), (0, 0.0)]
    return [(*around[i], *around[i - 1], *around[i + 1]) for i in range(1, len(around) - 1)]


@functools.cache
def tree(without: int = -1):
    """The tree grown on all labelled pages but one."""
    pages = [p for i, p in enumerate(LABELLED) if i != without]
    return grow(np.array([r for p in pages for r in rows_of(p)], float), np.array([b[2] for p in pages for b in p], float), depth=4, least=2)


def _container(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is the article."""
    boiler = name in _BOILER or (name == "header" and not in_article)
    article = name in ("article", "main")
    if attributes and not article and name not in ("html", "body"):
        for key, value in _ATTRIBUTES.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                boiler |= bool(_HINT.search(value)) or (not in_article and bool(_FRAME.search(value)))
                article |= not boiler and value in ("article", "content", "main", "main-content", "post", "entry-content", "article-body")
            elif key == "role":
                boiler |= value in _ROLES
                article |= value in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                boiler = True
    return boiler, article and not boiler


def blocks(page: str) -> list[tuple[str, int, float, bool, bool]]:
    """(text, words, link density, in boilerplate, in article) of each flat text block, in page order."""
    out: list[tuple[str, int, float, bool, bool]] = []
    text: list[str] = []
    linked, link, boiler, article = 0, 0, 0, 0
    stack: list[tuple[str, bool, bool]] = []
    open_: collections.Counter[str] = collections.Counter()  # names on the stack

    def close():
        nonlocal linked
        if text:
            whole = _WHITE.sub(" ", unescape("".join(text))).strip()
            if whole:
                n = whole.count(" ") + 1
                out.append((whole, n, min(1.0, linked / n), boiler > 0, article > 0))
            text.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        text.append(piece)
        if link:
            linked += len(piece.split())

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        if not m[0].endswith(">"):
            break
        name, end = m[2].lower(), bool(m[1])
        if name in _RAW and not end and not m[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if name == "a":
            link = 0 if end else 1
            continue
        if name in _INLINE:
            hidden = not end and name not in _VOID and m[3] and _container(name, m[3], True)[0]
            if hidden:
                close()
                stack.append((name, True, False))
                open_[name] += 1
                boiler += 1
            elif end and stack and stack[-1][0] == name:
                close()
                boiler -= stack.pop()[1]
                open_[name] -= 1
            elif name == "br":
                text.append(" ")
            continue
        close()
        if name in _VOID:
            continue
        if end:
            if open_[name]:
                while stack:
                    was, b, a = stack.pop()
                    open_[was] -= 1
                    boiler -= b
                    article -= a
                    if was == name:
                        break
            if name not in ("p",):
                link = 0
        else:
            if name in _PARAGRAPHS:
                while stack and stack[-1][0] in _PARAGRAPHS and (stack[-1][0] == name or stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6")):
                    was, b, a = stack.pop()
                    open_[was] -= 1
                    boiler -= b
                    article -= a
            elif name in ("article", "main", "section", "div", "footer", "header", "nav", "aside", "body", "form"):
                while stack and stack[-1][0] in ("p", "head", "h1", "h2", "h3", "h4", "h5", "h6"):
                    was, b, a = stack.pop()
                    open_[was] -= 1
                    boiler -= b
                    article -= a
            if not m[3].endswith("/"):
                b, a = _container(name, m[3], article > 0)
                stack.append((name, b, a))
                open_[name] += 1
                boiler += b
                article += a
    if at < len(page):
        add(page[at:])
    close()
    return out


def main_text(page: str | None, model) -> str:
    found = [b for b in blocks(page or "") if not b[3]]
    found = [b for b in found if b[4]] or found
    kept = (b[0] for b, row in zip(found, rows_of([b[1:3] for b in found]), strict=True) if judge(model, row) >= 0.5)
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages but html, plus text and n_chars.

    A null or empty page, or one without main text, gives the empty text. Character references are decoded, white space within a block is one
    space, blocks are joined by one newline. Columns named text or n_chars are replaced. One pass, no shuffle; repeated rows are treated alike.
    """
    columns = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    model = tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    schema = pages.select(*columns).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*columns, F.col(html)).mapInArrow(run, schema)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
