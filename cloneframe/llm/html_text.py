"""Main text of web pages by line-block distribution.

Markup is stripped to lines: each block element's text is a line, in page order; inline tags leave nothing. Elements
that never hold the article leave no line: scripts, styles, forms, navigation, asides, footers, hidden parts, and
parts whose role, class or id says menu, advert, notice, comment and so on. A class or id counts by its whole name; by
a part of it (`site-header`) only outside a marked article, and only in an element that holds neither a heading of the
first level nor most of the page's text. Elements that hold a marked article stay.

A line's weight is its length without link text. A heading of the first level weighs `surge` more, since an article
begins with it. Where the page marks an article or main element, its lines weigh `dive` more and other lines weigh the
`mark`th part. Weights are summed over windows of `block` lines. A surge is where the sum rises to the threshold, a
dive where it falls below `dive`; the lines between are the text, from the first to the last that has weight, and so
are up to `gap` lines without links between a dive and the next surge. The threshold is the lesser of `surge` and a
share of the page's largest sum, so a short article is found as a long one.

Cases: null or empty html, and html without text, give an empty text; unclosed elements reach no further than their
tag, so one lost end tag cannot swallow the page (an unclosed comment does, as in browsers); a tag that is never
closed is text; time is linear in the page's length, whatever is in it; repeated rows get equal results; an empty table
gives an empty table; page columns are carried.
"""

from __future__ import annotations

import html as references
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from cloneframe.llm.common import map_arrow

BLOCK = 3
SURGE = 80
SHARE = 0.3
DIVE = 15
MARK = 400
GAP = 6

# possessive: what has matched is never tried another way
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "noembed", "noframes", "iframe"}
ENDS = {name: re.compile(f"</{name}\\b[^>]*>", re.I) for name in RAW}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = set("head nav footer aside form button select dialog svg canvas object audio video template datalist menu map math applet".split())
HEART = {"article", "main"}
HEADS = {"h1", "h2"}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
HINTS = set(
    "ad ads adbox advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside "
    "widget footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist disqus reply replies respond pagination pager tagcloud copyright toolbar search outbrain taboola disclaimer".split()
)
ATTRIBUTE = re.compile(r"""([\w-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names(attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes call it boilerplate: by role, state or a whole class or id; by a part of one."""
    if not attributes.strip():
        return False, False
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in ROLES:
        return True, True
    names = f"{found.get('class', '')} {found.get('id', '')}"
    return any(n.lower() in HINTS for n in names.split()), any(p.lower() in HINTS for p in NAME_PART.findall(names))


def _tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag; raw elements' contents and comments count as one, ''."""
    out = []
    at, last = 0, page.rfind(">")
    tag = TAG
    lost: set[str] = set()  # raw elements without an end tag from here on
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            out.append((at, end, "", False, ""))
            at = end
            continue
        if at > last:
            break
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            out.append((at, end, "", False, ""))
            at = end
            continue
        if not (page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/" and page[at + 2 : at + 3].isalpha()):
            at += 1
            continue
        m = tag.match(page, at)
        if not m and tag is TAG:  # a quotation mark is open from here to the page's end: no more heed to them
            tag = LOOSE
            m = tag.match(page, at)
        if not m:
            at += 1
            continue
        name, closing, end = m[1].lower(), page[at + 1] == "/", m.end()
        if name in RAW and not closing and name not in lost:
            if stop := ENDS[name].search(page, end):
                out.append((at, stop.end(), "", False, ""))
                at = stop.end()
                continue
            lost.add(name)
        out.append((at, end, name, closing, m[2]))
        at = end
    return out


def _ends(tokens) -> dict[int, int]:
    """Index of the end tag of each start tag that has one."""
    open_: dict[str, list[int]] = {}
    out = {}
    for i, (_, _, name, closing, _) in enumerate(tokens):
        if not name or name in VOID:
            continue
        if closing:
            if open_.get(name):
                out[open_[name].pop()] = i
        else:
            open_.setdefault(name, []).append(i)
    return out


def _before(flags) -> list[int]:
    """How many of the flags before each place are set, and of all."""
    return [0, *itertools.accumulate(int(f) for f in flags)]


class Line(NamedTuple):
    text: str
    plain: int  # length without link text
    first: bool  # a heading of the first level
    marked: bool  # inside a marked article


def lines(page: str) -> list[Line]:
    """The blocks of the page that have text and are not boilerplate."""
    tokens = _tokens(page)
    ends = _ends(tokens)
    starts = {i for i, (_, _, name, closing, _) in enumerate(tokens) if name in HEART and not closing}
    marked = {i: ends[i] for i in starts if i in ends}
    hearts = _before(i in starts for i in range(len(tokens)))
    first = _before(t[2] == "h1" for t in tokens)
    heads = _before(t[2] in HEADS for t in tokens)
    # text before each token
    texts = list(itertools.accumulate((tokens[i][0] - (tokens[i - 1][1] if i else 0) for i in range(len(tokens))), initial=0))[1:]
    half = (texts[-1] + len(page) - tokens[-1][1]) / 2 if tokens else 0
    out: list[Line] = []
    parts: list[str] = []
    linked = links = inside = 0
    title = False
    heart_ends = set(marked.values())

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, max(0, len(text) - linked), title, inside > 0))
            parts.clear()
        linked = 0

    def boilerplate(i: int, stop: int) -> bool:
        _, _, name, _, attributes = tokens[i]
        if hearts[stop] > hearts[i + 1]:
            return False
        if name in NEVER or name == "header" and not (inside and heads[stop] > heads[i]):
            return True
        whole, part = _names(attributes)
        if first[stop] > first[i + 1]:
            return False
        return whole or part and not inside and texts[stop] - texts[i] <= half

    at, i = 0, 0
    while i < len(tokens):
        start, end, name, closing, _ = tokens[i]
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += len(" ".join(page[at:start].split()))
        at = end
        if name and not closing and name not in VOID and name not in HEART and name not in ("html", "body"):
            stop = ends.get(i)
            if stop is not None and boilerplate(i, stop):
                flush()
                at, i = tokens[stop][1], stop + 1
                continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name and name not in INLINE:
            flush()
            title = name == "h1" and not closing
            if name not in VOID:
                links = 0
            if i in marked:
                inside += 1
            elif i in heart_ends:
                inside -= 1
        i += 1
    parts.append(page[at:])
    flush()
    return out


def weigh(found: list[Line], surge: int = SURGE, dive: int = DIVE, mark: int = MARK) -> list[int]:
    any_marked = any(x.marked for x in found)
    return [(x.plain if x.marked or not any_marked else x.plain // mark) + dive * x.marked + surge * (x.first and (x.marked or not any_marked)) for x in found]


def between(weights: list[int], free: list[bool], block: int = BLOCK, surge: int = SURGE, share: float = SHARE, dive: int = DIVE, gap: int = GAP) -> list[tuple[int, int]]:
    """Half-open line ranges from surge to dive; free: lines without links, which a gap may consist of."""
    n = len(weights)
    ends = [0, *itertools.accumulate(weights)]
    sums = [ends[min(n, i + block)] - ends[i] for i in range(n)]
    if not n or not max(sums):
        return []
    threshold = min(surge, share * max(sums))
    least = min(dive, threshold)
    out: list[tuple[int, int]] = []
    i = 0
    while i < n:
        if sums[i] < threshold or not weights[i]:
            i += 1
            continue
        j = i  # surge: the window begins with a line that has weight
        while j < n and sums[j] >= least:
            j += 1  # dive: the window from here has next to no weight
        while j < n and weights[j] and free[j] and j > i and sums[j] == ends[n] - ends[j]:
            j += 1  # what little is left of the page
        while not weights[j - 1]:
            j -= 1
        if out and i - out[-1][1] <= gap and all(free[out[-1][1] : i]):
            out[-1] = (out[-1][0], j)
        else:
            out.append((i, j))
        i = j
    return out


def main_text(page: str | None, block: int = BLOCK, surge: int = SURGE, share: float = SHARE, dive: int = DIVE, mark: int = MARK, gap: int = GAP) -> str:
    if not page:
        return ""
    found = lines(page)
    ranges = between(weigh(found, surge, dive, mark), [x.plain == len(x.text) for x in found], block, surge, share, dive, gap)
    return " ".join(found[k].text for i, j in ranges for k in range(i, j))


def extract(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns named in carry (all but html_col, if None), text and n_chars."""
    carry = [c for c in pages.columns if c != html_col] if carry is None else carry
    if clash := {"text", "n_chars"} & set(carry):
        raise ValueError(f"columns {sorted(clash)} are made here; rename yours")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    fields = [*((c, kinds[c]) for c in carry), ("text", "string"), ("n_chars", "long")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = [main_text(x.as_py()) for x in b.column(len(carry))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64(), size=len(text))], names=[*carry, "text", "n_chars"])

    return map_arrow(pages.select(*(f"`{c}`" for c in [*carry, html_col])), run, fields)
