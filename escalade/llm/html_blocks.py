"""Main text of web pages: flat text blocks classified by a decision tree on word count, link density and neighbours.

A page is cut into flat blocks at block-level tags. Each block gets its number of words, the share of them inside
links, the same two of the blocks before and after it, whether it is a heading, and what the nearest marked region
around it says (``article``/``main`` and content classes: 1; navigation, headers, footers, sidebars, adverts, notices,
forms, comments: -1; no mark: 0). A small CART tree, trained on the labelled blocks below, keeps or drops each block.

Character references are decoded once, white space inside a block (of any kind, no-break spaces included) becomes one
space, and the kept blocks are joined in page order by an empty line. Scripts, styles, markup comments and other
elements whose content isn't shown are skipped. Nothing else is dropped or capped.

Defined cases: a null or empty page, and a page with no kept block, gives an empty text; unclosed and stray tags are
tolerated (a head ends at the first text or element that can't stand in it; of another unclosed hidden element only the tag
is skipped, but script, style and textarea take the rest of the page), a tag cut off by the end of the page is dropped; repeated rows each give a row; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm.common import ready

# Elements whose content is never shown as text.
_HIDDEN = "script style noscript template svg math iframe object textarea select option button canvas audio video head title"
# Elements that don't break a line of text.
_INLINE = ("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
           "small span strike strong sub sup time tt u var wbr input")
# Elements that can stand in a head; any other, or text, ends one that isn't closed.
_IN_HEAD = "base basefont bgsound link meta noframes noscript script style template title head html"
# Elements whose content is no markup, so that an unclosed one takes the rest of the page.
_RAW = "script style textarea"
_VOID = "area base br col embed hr img input link meta param source track wbr"
# Elements and class or id words that mark regions.
_BOILER_TAGS = "nav header footer aside form menu dialog fieldset"
_CONTENT_TAGS = "article main"
_BOILER_WORDS = ("ad ads adbox adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav "
                 "navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead sidebar aside widget "
                 "comment comments respond discussion disqus reply replies cookie cookies consent gdpr notice notification "
                 "alert popup modal overlay subscribe subscription newsletter signup login register form search share "
                 "sharing social related recommended recommendations trending popular tags toolbar pagination pager "
                 "copyright legal disclaimer skip toc")
_CONTENT_WORDS = "article content post entry story body maincontent mainbody articlebody postbody entrybody"

HIDDEN, INLINE, VOID = (frozenset(x.split()) for x in (_HIDDEN, _INLINE, _VOID))
BOILER_TAGS, CONTENT_TAGS = frozenset(_BOILER_TAGS.split()), frozenset(_CONTENT_TAGS.split())
BOILER_WORDS, CONTENT_WORDS = frozenset(_BOILER_WORDS.split()), frozenset(_CONTENT_WORDS.split())
IN_HEAD, RAW = frozenset(_IN_HEAD.split()), frozenset(_RAW.split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "heading", "region")

#: The labelled table: the features above, then 1 (main text) or 0.
LABELLED_BLOCKS = [
    # inside an article: paragraphs and headings of any length, also between short or linked neighbours
    (120, 0.00, 12, 0.00, 90, 0.00, 0, 1, 1), (60, 0.02, 8, 0.00, 75, 0.05, 0, 1, 1), (25, 0.00, 30, 0.00, 4, 0.00, 0, 1, 1),
    (8, 0.00, 20, 0.00, 60, 0.00, 1, 1, 1), (2, 0.00, 5, 0.90, 40, 0.00, 1, 1, 1), (1, 0.00, 60, 0.00, 60, 0.00, 0, 1, 1),
    (3, 0.00, 0, 0.00, 0, 0.00, 0, 1, 1), (15, 0.20, 50, 0.00, 10, 1.00, 0, 1, 1), (40, 0.45, 45, 0.05, 30, 0.00, 0, 1, 1),
    (300, 0.01, 3, 1.00, 2, 1.00, 0, 1, 1), (12, 0.30, 80, 0.00, 70, 0.00, 0, 1, 1), (5, 0.00, 1, 1.00, 9, 0.00, 0, 1, 1),
    (3, 0.00, 40, 0.00, 2, 0.00, 0, 1, 1), (2, 0.00, 3, 0.00, 2, 0.00, 0, 1, 1), (9, 0.00, 60, 0.00, 0, 0.00, 0, 1, 1),
    (5, 0.00, 9, 0.00, 1, 1.00, 0, 1, 1), (4, 0.00, 4, 0.00, 4, 0.00, 0, 1, 1), (14, 0.00, 2, 0.00, 3, 0.00, 0, 1, 1),
    (1, 0.00, 4, 0.00, 0, 0.00, 0, 1, 1), (11, 0.10, 14, 0.00, 5, 0.00, 0, 1, 1), (6, 0.00, 22, 0.00, 6, 0.60, 0, 1, 1),
    (4, 0.00, 30, 0.00, 2, 0.00, 1, 1, 1), (3, 0.00, 1, 0.00, 1, 0.00, 1, 1, 1), (2, 0.50, 6, 0.00, 5, 0.00, 0, 1, 1),
    # link lists inside an article
    (3, 1.00, 40, 0.00, 3, 1.00, 0, 1, 0), (6, 1.00, 3, 1.00, 4, 1.00, 0, 1, 0), (2, 0.95, 25, 0.00, 2, 1.00, 0, 1, 0),
    (9, 0.90, 60, 0.00, 0, 0.00, 0, 1, 0),
    # a heading that is a link to the page itself, or in an article's own header
    (7, 1.00, 5, 1.00, 60, 0.00, 1, 1, 1), (9, 0.00, 4, 1.00, 70, 0.00, 1, 1, 1),
    # inside marked boilerplate: menus, headers, footers, adverts, notices, comments, however long
    (1, 1.00, 1, 1.00, 1, 1.00, 0, -1, 0), (2, 1.00, 2, 1.00, 2, 1.00, 0, -1, 0), (20, 0.00, 1, 1.00, 8, 0.00, 0, -1, 0),
    (60, 0.00, 90, 0.00, 5, 0.50, 0, -1, 0), (15, 0.00, 80, 0.00, 0, 0.00, 0, -1, 0), (9, 0.10, 200, 0.00, 0, 0.00, 0, -1, 0),
    (120, 0.02, 60, 0.00, 40, 0.00, 0, -1, 0), (4, 0.00, 10, 0.00, 12, 0.00, 1, -1, 0), (35, 0.00, 35, 0.00, 40, 0.00, 0, -1, 0),
    (6, 0.50, 7, 1.00, 30, 0.00, 0, -1, 0), (250, 0.00, 20, 0.00, 3, 0.00, 0, -1, 0), (3, 0.00, 2, 0.00, 60, 0.00, 1, -1, 0),
    # unmarked: long blocks with few links, and blocks near them
    (80, 0.00, 60, 0.00, 70, 0.00, 0, 0, 1), (45, 0.05, 2, 1.00, 60, 0.00, 0, 0, 1), (22, 0.10, 50, 0.00, 45, 0.02, 0, 0, 1),
    (150, 0.10, 3, 1.00, 4, 0.80, 0, 0, 1), (12, 0.00, 60, 0.00, 55, 0.00, 0, 0, 1), (9, 0.00, 3, 0.90, 70, 0.00, 1, 0, 1),
    (5, 0.00, 40, 0.00, 65, 0.00, 1, 0, 1), (18, 0.00, 35, 0.10, 22, 0.00, 0, 0, 1), (17, 0.00, 45, 0.00, 6, 0.90, 0, 0, 1),
    (30, 0.00, 4, 0.00, 28, 0.00, 0, 0, 1),
    (60, 0.00, 2, 0.00, 3, 0.00, 0, 0, 1), (100, 0.02, 3, 0.00, 2, 1.00, 0, 0, 1), (28, 0.00, 60, 0.00, 3, 0.00, 0, 0, 1),
    (40, 0.00, 2, 0.50, 5, 0.00, 0, 0, 1), (200, 0.05, 0, 0.00, 0, 0.00, 0, 0, 1), (35, 0.00, 0, 0.00, 8, 1.00, 0, 0, 1),
    (50, 0.20, 45, 0.00, 2, 0.00, 0, 0, 1), (33, 0.00, 12, 0.00, 11, 0.00, 0, 0, 1), (4, 0.00, 45, 0.00, 40, 0.00, 0, 0, 1),
    # unmarked: link lists, and short blocks away from long ones
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0), (4, 1.00, 3, 1.00, 5, 1.00, 0, 0, 0), (3, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0),
    (6, 0.00, 4, 0.60, 5, 1.00, 0, 0, 0), (8, 0.75, 6, 0.80, 70, 0.00, 0, 0, 0), (25, 0.80, 10, 0.90, 12, 0.85, 0, 0, 0),
    (5, 0.00, 6, 0.00, 4, 0.00, 0, 0, 0), (2, 0.00, 9, 0.00, 0, 0.00, 0, 0, 0), (7, 0.00, 3, 1.00, 2, 1.00, 1, 0, 0),
    (60, 0.70, 8, 1.00, 20, 0.60, 0, 0, 0), (3, 0.66, 60, 0.00, 4, 0.90, 0, 0, 0), (9, 0.90, 55, 0.00, 60, 0.00, 0, 0, 0),
]

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
                   |<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)
                   |</?[a-zA-Z][^>]*(?:>|\Z)  # a quote isn't closed""", re.S | re.X)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDES = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
_WORD_PARTS = re.compile(r"[a-z]+")


def _region(name: str, attrs: str) -> int:
    """1 for content, -1 for boilerplate, 0 if the element says nothing."""
    if name in CONTENT_TAGS:
        return 1
    if name in BOILER_TAGS:
        return -1
    if attrs and "=" in attrs:
        said = set()
        for value in _NAMED.findall(attrs):
            said.update(_WORD_PARTS.findall(value.lower()))
        if said & BOILER_WORDS:
            return -1
        if said & CONTENT_WORDS:
            return 1
    return 0


def _closed(page: str, name: str, at: int) -> int:
    """Where a hidden element that began before ``at`` ends (an option also where the next one or its list's end begins);
    -1 if it isn't closed."""
    next_one = r"|(?=<option\b|</?optgroup\b|</(?:select|datalist)\b)" if name == "option" else ""
    shut = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z){next_one}", re.I).search(page, at)
    return shut.end() if shut else len(page) if name in RAW else -1


def _head_end(page: str, at: int) -> int:
    """Where the head that began before ``at`` ends: behind its end tag, or at the first text or element that can't stand in
    it."""
    while m := _TAG.search(page, at):
        if page[at:m.start()].strip():
            return at
        name = (m.group(3) or "").lower()
        if m.group(2):
            if name in ("head", "body", "html"):
                return m.end() if name == "head" else m.start()
        elif name and name not in IN_HEAD:
            return m.start()
        at = m.end()
        if name in HIDDEN and name != "head" and not m.group(2):
            shut = _closed(page, name, at)
            if shut < 0 and name == "title":
                shut = page.find("<", at)
                shut = shut if shut >= 0 else len(page)
            at = max(at, shut)
    return at if page[at:].strip() else len(page)


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, heading, region) of each flat block of a page that has words."""
    out: list[tuple[str, int, float, int, int]] = []
    open_: list[tuple[str, int]] = []  # open elements that mark a region or could be closed by name
    state = {"parts": [], "linked": 0, "heading": 0}
    in_link = 0
    unclosed: set[str] = set()  # hidden elements that no end tag follows any more

    def flush() -> None:
        words = "".join(state["parts"]).split()
        if words:
            region = next((r for _, r in reversed(open_) if r), 0)
            heading = state["heading"]
            if region < 0 and heading and any(n in CONTENT_TAGS for n, _ in open_) and \
                    all(n == "header" for n, r in open_ if r < 0):
                region = 1  # the title in an article's own header
            out.append((" ".join(words), len(words), min(1.0, state["linked"] / len(words)), heading, region))
        state["parts"], state["linked"] = [], 0

    def text(raw: str) -> None:
        shown = html.unescape(raw) if "&" in raw else raw
        state["parts"].append(shown)
        if in_link:
            state["linked"] += len(shown.split())

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            if m.group(1):
                state["parts"].append(m.group(1))  # CDATA: text without references
            continue
        closing, attrs = bool(m.group(2)), m.group(4) or ""
        if not closing and name in HIDDEN:
            if not attrs.rstrip().endswith("/") or name in ("script", "style"):
                shut = _head_end(page, at) if name == "head" else -1 if name in unclosed else _closed(page, name, at)
                if shut < 0:
                    unclosed.add(name)  # only its tag is skipped
                at = max(at, shut)
            if name not in ("button", "select", "option", "svg", "math"):
                flush()
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            state["parts"].append(" ")
            continue
        mark = 0 if closing or name in VOID else _region(name, attrs)
        if not closing and name not in VOID and _HIDES.search(attrs):
            mark = -1
        if name in INLINE and not mark:
            if not closing or not any(n == name for n, r in open_ if r):
                continue
        flush()
        state["heading"] = 0
        if closing:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
        else:
            while open_ and open_[-1][0] == "p" and name not in INLINE:
                open_.pop()  # a paragraph ends where the next block begins
            if name not in VOID:
                if name in HEADINGS:
                    state["heading"] = 1
                elif name in ("li", "dt", "dd", "tr", "td", "th") and open_ and open_[-1][0] == name:
                    open_.pop()
                if name not in HEADINGS:
                    open_.append((name, mark))
                elif mark:
                    open_.append((name, mark))
    flush()
    return out


def train_tree(rows=LABELLED_BLOCKS, max_depth: int = 6, min_leaf: int = 1):
    """A CART tree by Gini impurity: nested (feature, bound, at most, above), leaves are 0 or 1."""
    n1 = sum(r[-1] for r in rows)
    if max_depth == 0 or n1 in (0, len(rows)) or len(rows) < 2 * min_leaf:
        return int(2 * n1 >= len(rows))
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for lo, hi in zip(values, values[1:]):
            bound = (lo + hi) / 2
            sides = [[r for r in rows if r[f] <= bound], [r for r in rows if r[f] > bound]]
            if min(map(len, sides)) < min_leaf:
                continue
            impurity = sum(len(s) * (p := sum(r[-1] for r in s) / len(s)) * (1 - p) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, bound, sides)
    if best is None:
        return int(2 * n1 >= len(rows))
    _, f, bound, sides = best
    return f, bound, *(train_tree(s, max_depth - 1, min_leaf) for s in sides)


def classify(tree, features) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree) -> str:
    found = blocks(page) if page else []
    kept = []
    for i, (text, words, density, heading, region) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if classify(tree, (words, density, *before, *after, heading, region)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            tree=None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    ready(pages.sparkSession)
    tree = train_tree() if tree is None else tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # ids as they are
            texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
