"""The rows of tables in a page, from its tags: a helper for one page.

Tags are read one after another with a stack of what is open. A new cell ends an open one, a new row an open row of its table, and the end of a
table, or of the page, whatever is open in it, so end tags may be missing; a table in a cell is part of the cell, and its rows are rows too. Values in
quotes may hold ">"; from a quote that never closes on, tags end at the next ">", and its own value counts as absent. Comments, scripts and styles are no text. Time is linear in the page.

Plain pages, without comments, scripts and unclosed quotes, are cut at all tags at once; others tag by tag, with the same tokens.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

OPENS = re.compile(r"</?([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
#: A whole tag (name, attributes); or, without groups, what only the reader of odd pages understands, with all that follows.
WHOLE = re.compile(r"""<(/?[a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(?:/?[a-zA-Z]|[!?])(?s:.*)""")
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CLASS, HREF = (re.compile(rf"(?:^|[\s\"'/]){name}(?:{VALUE}|(?=[\s/]|$))", re.I) for name in ("class", "href"))
SILENT = {"script", "style"}
CELLS = {"td", "th"}
ENDS = {"/tr", "/td", "/th", "/table", "/div", "/span"}


@dataclass(slots=True)
class Cell:
    text: str = ""
    spans: list[str] = field(default_factory=list)
    href: str | None = None


@dataclass(slots=True)
class Row:
    """cls: value of the class attribute, None without one; divs: texts of innermost div elements."""

    cls: str | None
    cells: list[Cell] = field(default_factory=list)
    divs: list[str] = field(default_factory=list)
    text: str = ""


def collapsed(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((html.unescape(text) if "&" in text else text).split())


def _attribute(pattern: re.Pattern, text: str) -> str | None:
    m = pattern.search(text) if text else None
    return None if m is None else html.unescape(next((g for g in m.groups() if g is not None), ""))


def _tokens(page: str):
    """(text, tag, attributes) in order: a tag and the text before it, both may be empty."""
    cut = WHOLE.split(page)
    names = [n and n.lower() for n in cut[1::3]]
    if None in names or not SILENT.isdisjoint(names):
        return ((text, tag or "", attributes) for text, tag, attributes in _odd_tokens(page))
    return zip(cut[::3], [*names, ""], [*cut[2::3], ""])


def _odd_tokens(page: str):
    """(text, None, "") and ("", tag, attributes) in order; a closing tag begins with "/"."""
    at, told, quoted, size = 0, 0, True, len(page)
    while (at := page.find("<", at)) >= 0:
        m = OPENS.match(page, at)
        if m is None and not page.startswith(("<!", "<?"), at):  # text
            at += 1
            continue
        if told < at:
            yield page[told:at], None, ""
        if m is None:
            end = page.find("-->", at) if page.startswith("<!--", at) else page.find(">", at)
            at = told = size if end < 0 else end + (3 if page.startswith("<!--", at) else 1)
            continue
        whole = REST.match(page, m.end()) if quoted else None
        if whole is None:
            quoted = False
            end = page.find(">", m.end())
            end = size if end < 0 else end + 1
        else:
            end = whole.end()
        name = m[1].lower()
        if name in SILENT and page[at + 1] != "/":
            close = re.compile(rf"</{name}\b", re.I).search(page, end)
            at = told = size if close is None else close.start()
            continue
        yield "", ("/" if page[at + 1] == "/" else "") + name, page[m.end() : end - 1]
        at = told = end
    if told < size:
        yield page[told:], None, ""


#: An open element: name, where its text begins, what it belongs to; for a span its place in the cell, for a div whether another stands in it.
NAME, START, OWNER, PLACE, DIVIDED = range(5)


def _within(open_: list[list], names: set[str], stop: str) -> int | None:
    """Place of the innermost open element of these names that no `stop` element lies above."""
    for k in range(len(open_) - 1, -1, -1):
        name = open_[k][NAME]
        if name in names:
            return k
        if name == stop:
            return None
    return None


def table_rows(page: str) -> list[Row]:
    """All rows in the order in which they begin."""
    found: list[Row] = []
    open_: list[list] = []
    rows: list[Row] = []  # the open ones, as the next two
    cells: list[Cell] = []
    divs: list[list] = []
    parts: list[str] = []

    def shut(upto: int) -> None:
        """Ends all elements from a place of the stack on, the innermost first."""
        while len(open_) > upto:
            name, start, owner, place, divided = open_.pop()
            if name == "tr":
                rows.pop().text = collapsed(parts[start:])
            elif name in CELLS:
                cells.pop().text = collapsed(parts[start:])
            elif name == "span" and place >= 0:
                owner.spans[place] = collapsed(parts[start:])
            elif name == "div":
                divs.pop()
                if not divided:
                    owner.divs.append(collapsed(parts[start:]))

    for text, tag, attributes in _tokens(page):
        if text:
            parts.append(text)
        if not tag:
            continue
        parts.append(" ")  # a tag parts words
        if tag in ENDS:
            name = tag[1:]
            if open_ and open_[-1][NAME] == name:
                shut(len(open_) - 1)
            else:
                k = _within(open_, {name}, "" if name == "table" else "table")
                if k is not None:
                    shut(k)
        elif tag == "tr" or tag in CELLS:
            k = _within(open_, {"tr"} if tag == "tr" else CELLS, "table")
            if k is not None:
                shut(k)
            if tag == "tr":
                found.append(Row(_attribute(CLASS, attributes)))
                rows.append(found[-1])
                open_.append(["tr", len(parts), None, -1, False])
            elif rows:
                cells.append(Cell())
                rows[-1].cells.append(cells[-1])
                open_.append([tag, len(parts), None, -1, False])
        elif tag == "table":
            open_.append([tag, len(parts), None, -1, False])
        elif tag == "div" and rows:
            if divs:
                divs[-1][DIVIDED] = True
            divs.append([tag, len(parts), rows[-1], -1, False])
            open_.append(divs[-1])
        elif tag == "span" and rows:
            place = -1
            if cells:
                place = len(cells[-1].spans)
                cells[-1].spans.append("")
            open_.append([tag, len(parts), cells[-1] if cells else None, place, False])
        elif tag == "a":
            if cells and cells[-1].href is None:
                cells[-1].href = _attribute(HREF, attributes)
    shut(0)
    return found


def parsed(page: str) -> list[dict]:
    """table_rows as plain values: cls, cells (text, spans, href), divs, text."""
    return [{"cls": r.cls, "cells": [{"text": c.text, "spans": c.spans, "href": c.href} for c in r.cells], "divs": r.divs, "text": r.text} for r in table_rows(page)]
