"""Main text of HTML pages by line-block distribution.

Markup is stripped first: tags become block ends, and scripts, styles and comments go, as do elements whose tag, role or
style says that they are a menu, header, footer, sidebar, form, dialog or hidden. A class or id that names such a part only
makes its element a candidate: it goes unless it holds the page's article, or, in several lines, ``BODY`` of all text.
What has gone leaves no lines behind. The lines' text lengths, summed over sliding windows of ``WIDTH`` lines, rise and
fall along the page; a window with more than ``LINKS`` of its text in links sums to nothing. Where
the sum first reaches ``SURGE`` the text begins, where it last falls to nothing after a surge it ends, and what lies
between is kept, but for runs of links. If the page marks an article, its lines are the page, and any text counts as
a surge, so all of it is kept.

Defined results: null or empty html, or a page without text, gives the empty string; unclosed tags
end with their parent; a ``<`` that opens no tag is text; repeated rows give the same text
each. The columns returned are ``page_id``, ``url``, ``text``, ``n_chars``; others are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, SURGE, LINKS, BODY = 3, 86, 0.5, 0.8

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^"'<>]|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Elements whose content is never page text, up to their end tag.
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "object", "canvas", "math")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
_CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table figure fieldset menu dialog details blockquote center head button".split())
_BOILERPLATE = frozenset("nav footer aside form menu dialog button head".split())
_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
nav navbar navigation menu breadcrumb breadcrumbs header masthead footer topbar toolbar sidebar sidenav aside widget
cookie cookies consent gdpr notice notices notification notifications disclaimer popup modal overlay
newsletter subscribe subscription signup login search form
comment comments discussion disqus reply replies respond
social share sharing related recommended pagination pager copyright
""".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())


GONE, CANDIDATE, TEXT, MAIN = range(4)


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    """What an element is by its tag and attributes."""
    if tag in _BOILERPLATE or (tag == "header" and not in_article):
        return GONE
    kind = MAIN if tag in ("article", "main") else TEXT
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            if value.lower() in _ROLES:
                return GONE
            kind = MAIN if value.lower() in ("main", "article") else kind
        elif name in ("class", "id"):
            if kind == TEXT and tag not in ("html", "body", "header") and any(w.lower() in _NAMES for w in _NAME.findall(value)):
                kind = CANDIDATE
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return GONE
    return kind


class Line(NamedTuple):
    text: str
    links: int  # characters in links
    inside: bool  # the article
    part: int  # innermost candidate around it, or -1


def lines_of(page: str) -> list[Line]:
    """Lines of a page in order, empty where only markup was, without boilerplate."""
    lines: list[Line] = []
    parts: list[str] = []
    above: list[int] = []  # of every candidate, the one around it
    with_main: set[int] = set()
    stack: list[tuple[str, bool, bool, int]] = []  # tag, dropped, in the article, innermost candidate
    opened: Counter[str] = Counter()
    dropped, article, part = False, False, -1
    in_link, link_chars, at = 0, 0, 0

    def text(piece: str) -> None:
        nonlocal link_chars
        if piece and not dropped:
            parts.append(piece)
            if in_link:
                link_chars += len(piece)

    def end_line() -> None:
        nonlocal link_chars
        line = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if line or not lines or lines[-1].text:
            lines.append(Line(line, link_chars, article, part))
        parts.clear()
        link_chars = 0

    end, last = len(page), page.rfind(">") + 1  # no tag ends after ``last``, so none is looked for
    while at < end:
        m = _TAG.search(page, at, last)
        if m is None:
            stop = page.find("<!--", max(at, last))
            text(page[at:stop if stop >= 0 else end])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        tag = m[2].lower()
        closing = m[1] == "/"
        if tag in _RAW:
            if not closing and not m[3].endswith("/"):
                stop = _RAW[tag].search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in _INLINE:
            continue
        end_line()
        if tag not in _CONTAINERS:
            continue
        if closing:
            while opened[tag]:  # an end tag that fits none is passed over
                name = stack.pop()[0]
                opened[name] -= 1
                if name == tag:
                    break
        else:
            kind = _kind(tag, m[3], article)
            if kind == CANDIDATE and not dropped:
                above.append(part)
                part = len(above) - 1
            elif kind == MAIN and not dropped:
                with_main.add(part)
            stack.append((tag, dropped or kind == GONE, article or kind == MAIN, part))
            opened[tag] += 1
        _, dropped, article, part = stack[-1] if stack else ("", False, False, -1)
        in_link = 0
    end_line()
    return _without_parts(lines, above, with_main)


def _without_parts(lines: list[Line], above: list[int], with_main: set[int]) -> list[Line]:
    """Lines that are in no candidate, or only in such that are the page's body."""
    if not above:
        return lines
    size, count = [0] * len(above), [0] * len(above)
    total = 0
    for line in lines:
        total += len(line.text)
        if line.part >= 0 and line.text:
            size[line.part] += len(line.text)
            count[line.part] += 1
    main = [k in with_main for k in range(len(above))]
    for k in range(len(above) - 1, -1, -1):  # what is inside comes later
        if above[k] >= 0:
            size[above[k]] += size[k]
            count[above[k]] += count[k]
            main[above[k]] = main[above[k]] or main[k]
    stays = []
    for k, outer in enumerate(above):
        stays.append((outer < 0 or stays[outer]) and (main[k] or (count[k] >= WIDTH and size[k] >= BODY * total)))
    out: list[Line] = []
    for line in lines:
        if (line.part < 0 or stays[line.part]) and (line.text or not out or out[-1].text):
            out.append(line)
    return out


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    surge = SURGE
    if any(line.text and line.inside for line in lines):
        return " ".join(line.text for line in lines if line.text and line.inside)
    of_links = [2 * line.links > len(line.text) for line in lines]
    sums = []
    for i in range(len(lines)):
        total, links = sum(len(x.text) for x in lines[i:i + WIDTH]), sum(x.links for x in lines[i:i + WIDTH])
        sums.append(total if links <= LINKS * total else 0)
    if max(sums, default=0) < surge:
        surge = 1
    high = [i for i, n in enumerate(sums) if n >= surge]
    if not high:
        return ""
    start = stop = high[0]
    for i in high:
        if i >= stop:
            stop = i
            while stop < len(sums) and sums[stop] > 0:
                stop += 1
    # The last windows reach over lines that begin none of their own.
    kept = [k for k in range(start, min(len(lines), stop + WIDTH - 1)) if lines[k].text and any(sums[max(0, k - WIDTH + 1):k + 1])]
    while kept and of_links[kept[0]]:
        kept.pop(0)
    while kept and of_links[kept[-1]]:
        kept.pop()
    return " ".join(lines[k].text for k in kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row."""

    def extract(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
