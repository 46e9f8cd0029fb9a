"""Rows from the tag stream against a tree that the standard parser builds, on generated pages; and pages that mislead."""

import random
import time
from html.parser import HTMLParser

import pytest

from rillflow.functions.tables import parsed

VOID = {"br", "img", "input", "hr"}


class Tree(HTMLParser):
    """Elements as [tag, attributes, children], for markup whose end tags are all there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = [tag, dict(attrs), []]
        self.open[-1][2].append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.open[-1][2].append(data)


def texts(e):
    return e if isinstance(e, str) else " " + "".join(map(texts, e[2])) + " "


def flat(e):
    return " ".join(texts(e).split())


def under(e, names, stop=()):
    """Elements of these names below e in order; those below elements of `stop` are left out."""
    for c in e[2]:
        if not isinstance(c, str):
            if c[0] in names:
                yield c
            if c[0] not in stop:
                yield from under(c, names, stop)


def plain(page):
    p = Tree()
    p.feed(page)
    p.close()
    out = []
    for tr in under(p.root, {"tr"}):
        cells = list(under(tr, {"td", "th"}, {"table"}))
        own = lambda td, names: list(under(td, names, {"table"}))
        divs = [d for d in under(tr, {"div"}, {"table"}) if not any(True for _ in under(d, {"div"}))]
        links = [[a[1]["href"] for a in own(c, {"a"}) if "href" in a[1]] for c in cells]
        out.append({"cls": tr[1].get("class"), "cells": [{"text": flat(c), "spans": [flat(s) for s in own(c, {"span"})], "href": next(iter(x), None)} for c, x in zip(cells, links)], "divs": [flat(d) for d in divs], "text": flat(tr)})
    return out


def page(rng, depth=0):
    word = lambda: rng.choice(["Fall 2026", "a &amp; b", "x &lt; y", "GPA 3.5", "", "é日", "1 > 0", "caf&eacute;", "&nbsp;"])
    attrs = lambda: rng.choice(["", "", ' class="tw-border-none"', " class='a b'", " class=head", ' data-x="a>b"', ' title=\'<td>\' class="q&quot;r"'])

    def cell():
        inner = "".join(rng.choice([word(), f"<span>{word()}<b>{word()}</b></span>", f"<div>{word()}</div>", f"<div><div>{word()}</div> <div>{word()}<br>z</div></div>", f'<a href="/r/{rng.randint(1, 9)}?a=1&amp;b=2">see</a>', "<!-- <td>no</td> -->", "<script>'<tr><td>'</script>"]) for _ in range(rng.randint(0, 3)))
        return f"<td{attrs()}>{inner}</td>"

    rows = "".join(f"<tr{attrs()}>{''.join(cell() for _ in range(rng.randint(0, 4)))}</tr>\n" for _ in range(rng.randint(0, 5)))
    return f"<p>{word()}</p><table><tbody>{rows}</tbody></table>"


def test_generated_pages():
    rng = random.Random(5)
    for _ in range(1500):
        html = page(rng) + page(rng)
        assert parsed(html) == plain(html), html


def test_end_tags_may_be_missing():
    rng = random.Random(6)
    for _ in range(500):
        html = page(rng)
        short = html.replace("</td>", "").replace("</tr>", "")
        assert [(r["cls"], [(c["text"], c["href"]) for c in r["cells"]]) for r in parsed(short)] == [(r["cls"], [(c["text"], c["href"]) for c in r["cells"]]) for r in plain(html)], short


@pytest.mark.parametrize(
    "html, want",
    [
        ("<table><tr><td>a<table><tr class=in><td>b</td></tr></table>c</td><td>d</td></tr></table>", [(None, ["a b c", "d"]), ("in", ["b"])]),
        ("<tr><td>a<tr><td>b", [(None, ["a"]), (None, ["b"])]),
        ("<tr class><td>a</td></tr>", [("", ["a"])]),
        ('<tr class="x><td>a</td></tr><tr><td>b</td></tr>', [(None, ["a"]), (None, ["b"])]),
        ("<TR CLASS='A'><TD>x</TD><td>y</TR>", [("A", ["x", "y"])]),
        ("<td>no row</td>", []),
        ("", []),
        ("<tr", [(None, [])]),
        ("<tr><td>1 < 2 <3</td>", [(None, ["1 < 2 <3"])]),
    ],
)
def test_pages(html, want):
    assert [(r["cls"], [c["text"] for c in r["cells"]]) for r in parsed(html)] == want


@pytest.mark.parametrize("piece", ["<tr><td>x", '<tr class="x ', "<td>", "<!--", "<script>", "</table>", "<tr class='a' \""])
def test_time_is_linear(piece):
    began = time.time()
    parsed(piece * 20_000)
    assert time.time() - began < 10


@pytest.mark.parametrize("odd", ["", "<!-- note -->", "<script>'<tr>'</script>", "<p title='"])
def test_plain_and_odd_pages_give_the_same_rows(odd):
    """A page that is cut at once, and the same rows before a piece that needs the reader of odd pages."""
    rng = random.Random(9)
    for _ in range(300):
        html = page(rng).replace("<!-- <td>no</td> -->", "").replace("<script>'<tr><td>'</script>", "")
        assert parsed(html) == parsed(html + odd) == plain(html)


def test_plain_pages_are_cut_at_once():
    """A plain page costs less than one that is read tag by tag."""
    row = '<tr><td><div>MIT</div></td><td><span>Physics</span> <span>PhD</span></td><td>Sep 10, 2024</td><td><a href="/r/1">see</a></td></tr><tr class="tw-border-none"><td><div><div>Fall 2026</div><div>GPA 3.52</div></div></td></tr>'
    html, took = f"<table>{row * 400}</table>", []
    for text in (html, "<!-- -->" + html):
        times = []
        for _ in range(5):
            began = time.process_time()
            parsed(text)
            times.append(time.process_time() - began)
        took.append(min(times))
    assert took[0] < 0.8 * took[1]
