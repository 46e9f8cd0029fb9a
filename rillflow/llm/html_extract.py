"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text. Parts that are never main text (menus, page headers and footers, sidebars,
notices, adverts, forms, scripts, reader comments, hidden parts) leave none. Every line has a weight: its length, but nothing where most of it
is links; headings and lines of an article or main element weigh SURGE at least. Weights are summed over sliding windows of lines: text
surges where a window reaches SURGE (or half of the page's greatest window, if that is less) and dives where a whole window weighs nothing. Edges
of articles, and of parts left out between different containers, are a window of empty lines, so text dives there.

Of the runs between surges and dives the heaviest is kept, with the other runs and the short lines of the containers that surge in it, or with the runs of
all articles if it is one, in page order. What is kept is kept whole, links and short lines in it too. A form or dialog that holds the article, or more than
half of the page's text, is only a wrapper.

Character references are decoded, white space in a block becomes one space, blocks are joined by an empty line. Defined cases: null or
empty html, and pages without text, give an empty text; a page that is cut off ends where it ends (a tag cut in two
goes); a quoted value that never closes, or closes only beyond the next tag, does not hold its tag open; unclosed elements that are left
out end with the page, or before an article where they would swallow it; repeated rows and null ids are extracted like any other; an empty
table gives an empty result; other columns are ignored. Time is linear in the page.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from rillflow.llm.common import as_text, batch_of

WINDOW, SURGE = 3, 80
#: Element names by role.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video"}
NEVER = {"head", "title", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "option", "datalist"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
SPACES = {"br", "td", "th", "img", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
CONTAINERS = {"article", "main", "section", "div", "body", "td", "blockquote"}
WRAPS = {"form", "dialog"}  # some pages stand in one as a whole
EDGES = {"nav", "header", "footer", "aside"}  # these divide a page; other parts left out are holes in it
#: Whole class, id and role names (with "-" for "_") of parts that are not main text, anywhere and outside articles.
ANYWHERE = set("ad ads advert advertisement advertisements adsense adsbygoogle ad-banner ad-container ad-slot sponsored sponsored-content comments comment-list commentlist comments-area comment-section reader-comments disqus-thread".split())
OUTSIDE = ANYWHERE | set(
    "banner page-banner promo promotion popup cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice consent gdpr notice notices site-notice sidebar side-bar sidebar-left sidebar-right menu main-menu "
    "nav navbar nav-bar navigation main-nav breadcrumb breadcrumbs comment reply replies header site-header page-header masthead footer site-footer page-footer pagination pager complementary contentinfo skip-link".split()
)
NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?:\s|=|$|/)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
OPENS = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOPS = re.compile(r"""[>"']""")


class Tag(NamedTuple):
    """A piece of markup; name is "" for what only goes (comments, scripts and the like)."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""
    alone: bool = False  # ends itself: <x/>


class Line(NamedTuple):
    text: str
    linked: int  # characters in links
    firm: bool  # a heading, or in an article or main element
    main: bool
    container: int


class Gap(NamedTuple):
    container: int | None  # None: always a gap; else a hole between lines of this container


def _tag_end(page: str, at: int, absent: set[str]) -> int:
    """Place after the tag's ">"; the page's end if there is none. absent: quotes that do not occur any more."""
    while True:
        m = STOPS.search(page, at)
        if m is None:
            return len(page)
        if m[0] == ">":
            return m.end()
        at, before = m.end(), m.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] != "=" or m[0] in absent:  # only after "=" a quote opens a value
            continue
        close = page.find(m[0], at)
        if close < 0:
            absent.add(m[0])
            continue
        after = page.find(">", at, close)
        if after >= 0 and page.find("<", at, after) < 0 and page.find("<", after, close) >= 0:
            return after + 1  # the value would hold this tag's end and the next tag's start
        at = close + 1


def tags_of(page: str) -> list[Tag]:
    out, at, absent, unclosed = [], 0, set(), set()
    while (at := page.find("<", at)) >= 0:
        m = OPENS.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                to = page.find("-->", at + 4)
                to = len(page) if to < 0 else to + 3
            elif page.startswith("<![CDATA[", at):
                to = at + 9
            elif page[at + 1 : at + 2] in ("!", "?") and at + 1 < len(page):
                to = page.find(">", at)
                to = len(page) if to < 0 else to + 1
            else:  # text
                at += 1
                continue
            out.append(Tag(at, to))
            at = to
            continue
        name, to = m[2].lower(), _tag_end(page, m.end(), absent)
        attributes = page[m.end() : max(m.end(), to - 1)]
        alone = attributes.rstrip().endswith("/")
        if name in RAW and not m[1] and not alone:
            found = None if name in unclosed else re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, to)
            if found is None:
                unclosed.add(name)
            to = len(page) if found is None else found.end()
            out.append(Tag(at, to))
        else:
            out.append(Tag(at, to, name, bool(m[1]), attributes, alone))
        at = to
    return out


def _unwanted(tag: Tag, inside: int) -> bool:
    if tag.name in NEVER:
        return True
    if tag.name == "header":
        return not inside
    if not tag.attributes or tag.name in ("html", "body", "main"):
        return False
    if tag.name != "article" and HIDDEN.search(tag.attributes):
        return True
    named = {w for value in NAMES.findall(tag.attributes) for w in "".join(value).lower().replace("_", "-").split()}
    if tag.name == "article":  # a reader's comment, or a teaser of another page
        return bool(named & (ANYWHERE | {"comment", "reply", "related", "related-article", "teaser", "promo"}))
    return bool(named & (ANYWHERE if inside else OUTSIDE))


def _closings(tags: list[Tag]) -> list[int]:
    """Number of each opening tag's closing one, -1 where there is none."""
    out, open_ = [-1] * len(tags), {}
    for i, t in enumerate(tags):
        if t.closing:
            if open_.get(t.name):
                out[open_[t.name].pop()] = i
        elif t.name and not t.alone and t.name not in VOID:
            open_.setdefault(t.name, []).append(i)
    return out


def lines_of(page: str) -> list[Line | Gap]:
    """Blocks of text in page order, with gaps where main text can begin or end."""
    page = page.replace("]]>", "") if "<![CDATA[" in page else page
    tags = tags_of(page)
    closing, mains, told, resume = _closings(tags), [0], [0], [len(tags)] * (len(tags) + 1)
    for k, t in enumerate(tags):
        mains.append(mains[-1] + (t.name in MAIN and not t.closing))
        told.append(told[-1] + len(page[tags[k - 1].end if k else 0 : t.start].strip()))
    told.append(told[-1] + len(page[tags[-1].end if tags else 0 :].strip()))
    for i in range(len(tags) - 1, -1, -1):
        resume[i] = i if not tags[i].closing and (tags[i].name in MAIN or tags[i].name == "body") else resume[i + 1]
    lines: list[Line | Gap] = []
    parts: list[str] = []
    within, made, inside, links, linked, heading, at, i = [("", 0)], 0, 0, 0, 0, False, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, linked, heading or bool(inside), bool(inside), within[-1][1]))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    while i < len(tags):
        t = tags[i]
        if t.start > at:
            add(page[at : t.start])
        at, i = t.end, i + 1
        if not t.name:
            continue
        if not t.closing and t.name not in VOID and _unwanted(t, inside):
            if t.alone:
                continue
            end = closing[i - 1]
            if end >= 0 and t.name not in MAIN and (t.name not in NEVER or t.name in WRAPS):
                if mains[end] > mains[i] or t.name in WRAPS and not inside and 2 * (told[end] - told[i]) > told[-1]:  # holds the article itself, or most of the page
                    close()
                    continue
            if t.name in BLOCKS or t.name in NEVER:
                close()
            if t.name in EDGES and not inside:
                lines.append(Gap(within[-1][1]))
            i = end + 1 if end >= 0 else len(tags) if inside else resume[i]
            at = tags[end].end if end >= 0 else tags[i].start if i < len(tags) else len(page)
            continue
        if t.name in BLOCKS:
            close()
            heading = t.name in HEADINGS and not t.closing
        if t.name in MAIN:
            before, inside = inside, max(0, inside + (-1 if t.closing else 1))
            if not before or not inside:
                lines.append(Gap(None))
        if t.name in CONTAINERS:
            if not t.closing:
                made += 1
                within.append((t.name, made))
            elif any(n == t.name for n, _ in within):
                while within.pop()[0] != t.name:
                    pass
        elif t.name == "a":
            links = 0 if t.closing else 1
        elif t.name in SPACES:
            parts.append(" ")
    add(page[at:])
    close()
    return lines


def surges(weights: list[int], window: int, least: float) -> list[tuple[int, int]]:
    """(surge, dive) ranges: from a line whose window reaches `least`, and which gives its share of that, up to a window that weighs nothing."""
    sums, total, found, start = [0] * len(weights), 0, [], None
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i] - (weights[i + window] if i + window < len(weights) else 0)
        sums[i] = total
    for i, w in enumerate(weights):
        if start is None and w > 0 and w * window >= least and sums[i] >= least:
            start = i
        elif start is not None and sums[i] == 0:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(weights)))
    return found


def weight(line: Line, surge: int = SURGE) -> int:
    own = len(line.text) if line.main or 2 * line.linked <= len(line.text) else 0
    return max(own, surge) if line.firm else own


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    held, spread = lines_of(page), []
    after: list[int | None] = [None] * len(held)  # container of the next line
    for k in range(len(held) - 1, 0, -1):
        after[k - 1] = held[k].container if isinstance(held[k], Line) else after[k]
    before = None
    for k, x in enumerate(held):
        if isinstance(x, Line):
            spread.append(x)
            before = x.container
        elif x.container is None or not before == after[k] == x.container:
            spread.extend([None] * window)
    weights = [0 if x is None else weight(x, surge) for x in spread]
    greatest = max((sum(weights[i : i + window]) for i in range(len(weights))), default=0)
    runs = [[x for x in spread[a:b] if x is not None] for a, b in surges(weights, window, min(surge, greatest / 2))]
    if not runs:
        return ""
    best = max(runs, key=lambda r: sum(weight(x, 0) for x in r))
    if any(x.main for x in best):
        return "\n\n".join(x.text for r in runs if any(y.main for y in r) for x in r)
    # containers of the text that surges: their lines stay however short, but for those of links only that stand outside the runs
    homes = {x.container for x in best if weight(x, surge) * window >= min(surge, greatest / 2)}
    chosen = {id(x) for r in runs if r is best or any(x.container in homes for x in r) for x in r}
    return "\n\n".join(x.text for x in spread if x is not None and (id(x) in chosen or x.container in homes and weight(x, surge)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. No shuffle."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [main_text(p) for p in as_text(part.column(2))]
                yield batch_of(out, part.column(0).cast(pa.int64()), part.column(1), texts, [len(t) for t in texts])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")
