"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass 1 decides a block by where it stands (inside an element that
is boilerplate by name or class) and else by its length, link density and stop-word density, on pages with and
without an article element. Pass 2 gives each block left undecided the label of its nearest decided neighbours;
inside an article element that holds the page's prose the neighbours are those inside, and it is kept where there are none.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Element names and words of class, id and role.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav header footer aside form button select menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottom copyright comment comments commentlist reply replies respond disqus "
    "share sharing social related recommended recommendations more newsletter subscribe subscription signup login search pagination pager toolbar contentinfo complementary form skip hidden".split()
)
HEDGES = frozenset("with has no without is not".split())
#: Common words of the four languages.
STOP_WORDS = frozenset(
    "the of and to in is that for it as was on are by this be with from or an at not have but he she they we you his her its which "
    "de la le les des et en un une du est que qui dans pour par sur pas au plus avec ce il elle ne se ou "
    "der die das und ist den von zu mit dem nicht ein eine auf für im sich auch als an es des dass wird bei "
    "el los las y del se una por con para su al lo como más o pero sus esta son".split()
)
LINKY, LONG, STOPPY, VERY_LONG = 0.5, 15, 0.2, 60

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z))", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[^a-z0-9]+")
BAD, GOOD, OPEN = -1, 1, 0


def _is_bad(name: str, attrs: str, in_article: bool) -> bool:
    if name in BOILERPLATE:
        return not (name == "header" and in_article)
    if not attrs or name in ARTICLE or name in ("html", "body"):
        return False
    if _HIDDEN.search(attrs):
        return True
    for m in _NAMES.finditer(attrs):
        for word in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [p for p in _PART.split(word) if p]
            if parts and parts[0] not in HEDGES and (parts[0] in BAD_WORDS or parts[-1] in BAD_WORDS) and not (in_article and parts[-1] in ("header", "more", "side", "bottom")):
                return True
    return False


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters inside links, stands in boilerplate, stands in the article) of each block with text, in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements that aren't inline: name, boilerplate, article
    text: list[str] = []
    linked = links = breaks = pos = 0

    def flush() -> None:
        nonlocal linked, breaks
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, linked, bool(stack) and stack[-1][1], bool(stack) and stack[-1][2]))
            text.clear()
        linked = breaks = 0

    def add(piece: str) -> None:
        nonlocal linked, breaks
        if piece:
            text.append(piece)
            if not piece.isspace():
                breaks = 0
            if links:
                linked += len(piece)

    while True:
        m = _TOKEN.search(page, pos)
        if not m:
            break
        add(page[pos : m.start()])
        pos, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else len(page)
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                text.append(" ")
        elif name in INLINE:
            if not closing and m[3] and _is_bad(name, m[3], bool(stack) and stack[-1][2]):
                flush()
                stack.append((name, True, False))
            elif closing and stack and stack[-1][0] == name:
                flush()
                stack.pop()
        else:
            flush()
            links = 0
            if name in VOID:
                continue
            if not closing:
                if name == "p":
                    while stack and stack[-1][0] == "p":
                        stack.pop()
                bad, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                if not m[3].endswith("/"):
                    stack.append((name, bad or _is_bad(name, m[3], inside), inside or name in ARTICLE))
            elif any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
    add(page[pos:])
    flush()
    return out


def _settled(marks: list[int], default: int) -> list[int]:
    """Undecided marks get that of the nearest decided neighbours."""
    n, before, after = len(marks), [], []
    last = None
    for i, m in enumerate(marks):
        last = i if m else last
        before.append(last)
    last = None
    for i in range(n - 1, -1, -1):
        last = i if marks[i] else last
        after.append(last)
    after.reverse()
    out = []
    for i, m in enumerate(marks):
        if m == OPEN:
            p, q = before[i], after[i]
            if p is None and q is None:
                m = default
            elif p is None or q is None or marks[p] == marks[q]:
                m = marks[p if p is not None else q]
            else:
                m = marks[p] if i - p < q - i else marks[q] if q - i < i - p else GOOD
        out.append(m)
    return out


def decide(found: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """Which blocks are main text.

    Length, link density and stop words are read on every page. Article elements are a prior for what these leave
    open, unless long prose stands outside of them only: then they are teasers, and blocks inside count as others.
    """
    marks = []
    for text, linked, bad, _ in found:
        words = text.split()
        density, stops = linked / max(1, len(text)), sum(w.strip(".,;:!?").lower() in STOP_WORDS for w in words) / max(1, len(words))
        prose = (len(words) >= LONG and stops >= STOPPY) or len(words) >= VERY_LONG
        marks.append(BAD if bad or density > LINKY else GOOD if prose else OPEN)
    inside = [x[3] and not x[2] for x in found]
    prose_in, prose_out = (any(m == GOOD and i == where for m, i in zip(marks, inside)) for where in (True, False))
    if not any(inside) or (prose_out and not prose_in):
        return [m == GOOD for m in _settled(marks, GOOD)]
    outer = iter(_settled([m for m, i in zip(marks, inside) if not i], BAD))
    inner = iter(_settled([m for m, i in zip(marks, inside) if i], GOOD))
    return [next(inner if i else outer) == GOOD for i in inside]


def main_text(page: str | None) -> tuple[str, int, int]:
    """The text, its blocks, and the blocks left out."""
    found = blocks(page or "")
    keep = decide(found)
    return "\n".join(b[0] for b, k in zip(found, keep) if k), sum(keep), len(keep) - sum(keep)


def _extract(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            got = [main_text(x) for x in part.column(2).to_pylist()]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["page_id", "url", "text", "n_chars", "n_blocks", "n_dropped"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_dropped) for each row, from the whole html.

    Null and empty html give an empty text. Markup that breaks off is read as far as it goes. Repeated rows stay
    repeated; other columns are not read; an empty table gives no rows.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_blocks long, n_dropped long")
