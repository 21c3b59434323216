"""Main text of web pages by the line-block distribution.

Markup is stripped to lines, one per block element; what stands in menus,
headers, footers, sidebars, notices, adverts, forms and reader comments counts
as lines without text. The text lengths of ``WINDOW`` lines from each line on
are summed: where the sum rises from nothing is a surge point, where it falls
back to nothing a dive point, and the text between them is kept. Lines
outside a marked article that are mostly links have no length. A run of a page
without article must reach ``PEAK`` (else the highest run is kept) or share its
box with one that does. If a page marks its article, a run outside must also
reach the article's highest sum; articles lower than half of such a run (cards
of other stories) go. An element that class, id or role names mark is dropped
unless it holds all articles of the page, or nothing else has text.

Edge cases: null and empty html give the empty text; broken markup (unclosed
comments, scripts or quotes) never fails, an unclosed wrapper of side matter
is ignored, a ``<`` that begins no tag is text; repeated rows give repeated
results; an empty table stays empty; added columns replace columns of the same
name.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append_arrow, table

#: Lines of a window, and the window sum that a run of a page without marked article must reach.
WINDOW, PEAK = 3, 80
#: Weight of a marked article's window sums against those of text outside.
ARTICLE = 2
#: Share of link text from which a line outside a marked article counts as a menu's.
LINKS = 0.6

# elements without text of the page; the first kind runs to the end if it is not closed
_RAW = "script|style|textarea|iframe"
_DROP = "head|title|noscript|template|svg|object|select|button|canvas|audio|video|math"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({_RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\s*>|.*\Z)"
    rf"|<({_DROP})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?</\2\s*>"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S | re.I)
_SIDE = frozenset("nav footer aside form menu dialog fieldset".split())
_BOXES = frozenset("div section td body".split())
_CORE = frozenset(("article", "main"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr br nobr input picture source".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names that mark side matter.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "comment comments disqus replies respond widget toolbar pagination pager contentinfo complementary skip".split())
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Words after which a mark tells what a layout has or lacks.
_QUALIFIERS = frozenset("has no with without non".split())
_SPLIT = re.compile(r"[^a-z]+")


def _marked(attrs: str) -> bool:
    for groups in _NAMES.findall(attrs):
        for name in "".join(groups).split():
            # camelCase and dashed names fall into words
            parts = _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
            for before, part, after in zip(["", *parts], parts, [*parts[1:], ""]):
                if part in _MARKS and before not in _QUALIFIERS and after != "free":
                    return True
    return False


def _wraps(page: str, name: str, start: int, cores: list[int]) -> bool:
    """Whether the element ``name`` whose content begins at ``start`` holds all
    articles of the page, so it is a layout wrapper."""
    if not cores or cores[0] < start:
        return False
    depth = 1
    for m in _TOKEN.finditer(page, start):
        if m.start() > cores[-1]:
            return True
        if (m[4] or m[7] or "").lower() == name and not (m[5] or m[8] or "").endswith("/"):
            depth += -1 if m[3] or m[6] else 1
            if not depth:
                return False
    return False


def lines(page: str, marks: bool = True) -> list[tuple[str, int, bool, int]]:
    """The page as lines ``(text, characters of links, inside the marked
    article, number of the enclosing box)``; side matter gives ``WINDOW``
    empty lines."""
    out: list[tuple[str, int, bool, int]] = []
    boxes, n_boxes = [0], 0
    text: list[str] = []
    links, link, core, pos = 0, False, 0, 0
    skip, depth = "", 0
    low = None
    cores = [m.start() for m in _TOKEN.finditer(page) if not (m[3] or m[6]) and (m[4] or m[7] or "").lower() in _CORE]

    def flush():
        nonlocal links
        line = " ".join(references.unescape("".join(text)).split())
        if line:
            out.append((line, links, core > 0, boxes[-1]))
        text.clear()
        links = 0

    for m in _TOKEN.finditer(page):
        piece, pos = page[pos:m.start()], m.end()
        if not skip and piece:
            text.append(piece)
            if link:
                links += len(piece.strip())
        name = m[4] or m[7]
        if not name:
            continue
        closing, attrs = m[3] or m[6], m[5] or m[8] or ""
        name = name.lower()
        if skip:
            if name == skip and not attrs.endswith("/"):
                depth += -1 if closing else 1
                if not depth:
                    skip = ""
            continue
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            link = not closing
        if not closing and name not in _VOID and name not in _CORE and name not in ("html", "body") and (
                name in _SIDE or name == "header" and not core or attrs and (
                    _HIDDEN.search(attrs) or marks and _marked(attrs) and not _wraps(page, name, pos, cores))):
            low = page.lower() if low is None else low
            if low.find(f"</{name}", pos) >= 0:  # else nothing says where it ends
                flush()
                out += [("", 0, False, -1)] * WINDOW
                skip, depth, link = name, 1, False
                continue
        if name not in _INLINE:
            flush()
            if name in _BOXES:
                if not closing:
                    n_boxes += 1
                    boxes.append(n_boxes)
                elif len(boxes) > 1:
                    boxes.pop()
            if name in _CORE:
                if not closing and attrs and marks and _marked(attrs):
                    low = page.lower() if low is None else low
                    if low.find(f"</{name}", pos) >= 0:
                        out += [("", 0, False, -1)] * WINDOW
                        skip, depth = name, 1
                        continue
                core = max(0, core + (-1 if closing else 1))
    if not skip:
        text.append(page[pos:])
    flush()
    return out


def _runs(length: list[int]) -> list[tuple[int, int, int]]:
    """Runs from surge to dive point, with their highest window sum."""
    total = [sum(length[i:i + WINDOW]) for i in range(len(length))]
    runs, i = [], 0
    while i < len(length):
        if not length[i]:
            i += 1
            continue
        surge = i
        while i < len(length) and total[i]:
            i += 1
        runs.append((surge, i, max(total[surge:i])))  # i is the dive point
    return runs


def _chosen(got: list[tuple[str, int, bool, int]]) -> str:
    core = [len(t) if c else 0 for t, _, c, _ in got]
    free = [len(t) if t and not c and links <= LINKS * len(t) else 0 for t, links, c, _ in got]
    inside, outside = _runs(core), _runs(free)
    if inside:
        # text outside counts if it is as high as the article, an article from half the height of such text on
        top = max(p for *_, p in inside)
        outside = [r for r in outside if r[2] >= max(PEAK, top)]
        high = max((p for *_, p in outside), default=0)
        inside = [r for r in inside if ARTICLE * r[2] >= high] if high else inside
    elif outside:
        high = [r for r in outside if r[2] >= min(PEAK, max(p for *_, p in outside))]
        # a short run in the box of a high one was only cut off by side matter
        boxes = {got[i][3] for a, b, _ in high for i in range(a, b) if free[i]}
        outside = [r for r in outside if r in high or got[r[0]][3] in boxes]
    kept = sorted({i for runs, length in ((inside, core), (outside, free)) for a, b, _ in runs for i in range(a, b) if length[i]})
    return "\n".join(got[i][0] for i in kept)


def main_text(page: str | None) -> str:
    """The main text of a page, one line per block."""
    # a page whose names mark all of its text is judged without them
    return _chosen(lines(page or "")) or _chosen(lines(page or "", marks=False))


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``df`` with the main ``text`` of each whole page and ``n_chars``, its
    code points."""
    def kernel(cols):
        found = [main_text(p) for p in cols[0].to_pylist()]
        return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return append_arrow(df, [T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())], [html], kernel)


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")


QUERIES = {"op7_extract": op7_extract}
ORACLE_SQL: dict[str, str] = {}
