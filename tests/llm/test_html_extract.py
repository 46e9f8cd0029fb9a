"""Main text by line-block distribution: against a plain version, without the method, and on pages that mislead."""

import os
import random
import time

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillflow.llm.html_extract import Gap, Line, lines_of, main_text, surges

LONG = "A sentence that is long enough to count as text in every window of lines. "


def plain_surges(weights, window, least):
    """Line by line, every window summed anew."""
    found, start = [], None
    for i in range(len(weights)):
        s = sum(weights[i : i + window])
        if start is None:
            if weights[i] > 0 and weights[i] * window >= least and s >= least:
                start = i
        elif s == 0:
            found.append((start, i))
            start = None
    return found if start is None else [*found, (start, len(weights))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 5, 20, 90]), max_size=40), st.integers(1, 5), st.sampled_from([1, 30, 80]))
def test_surges(weights, window, least):
    assert surges(weights, window, least) == plain_surges(weights, window, least)


def page(rng):
    """A page without article or main: short lines, a list of links, the post in pieces, links between, a long note elsewhere."""
    item = lambda n: " ".join(rng.choice(["un", "der", "text", "line"]) for _ in range(n))
    post = [item(rng.randint(30, 60)) for _ in range(rng.randint(2, 5))]
    links = "".join(f"<li><a href='/{k}'>{item(4)}</a></li>" for k in range(6))
    return f"<body><div><p>{item(2)}</p><p>{item(1)}</p></div><ul>{links}</ul><div class='post'>" + "".join(f"<p>{p}</p>" for p in post) + f"</div><div><ul>{links}</ul></div><div><p>{item(3)}</p></div></body>", post


def test_the_distribution_chooses_the_text():
    rng, changed = random.Random(3), 0
    for _ in range(50):
        html, post = page(rng)
        assert main_text(html) == "\n\n".join(post)
        changed += main_text(html) != "\n\n".join(x.text for x in lines_of(html) if isinstance(x, Line))
    assert changed == 50


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><section id='related-work'><p>Body text.</p></section></article>", "Body text."),
        ("<article><p>a</p><div class='social-science'><p>b</p></div></article>", "a\n\nb"),
        ("<article><p>a</p><section class='Comments'><p>me too</p></section><div id=ad>buy</div></article>", "a"),
        ("<p data-x='a\"b>text<p>more", "text\n\nmore"),
        ('<p data-x="a>one<p class="b">two</p>', "one\n\ntwo"),
        ('<p title="a > b">one</p><p title="<i>x</i>">two</p>', "one\n\ntwo"),
        (f"<div class='post'><p>{LONG}</p><aside>x</aside><p>{LONG * 3}</p></div>", f"{LONG.strip()}\n\n{(LONG * 3).strip()}"),
        ("<article><p>one</p></article><article><p>two</p></article><p>left over</p>", "one\n\ntwo"),
        (f"<nav>x</nav><p>short</p><nav>y</nav><div><p>{LONG}</p></div>", LONG.strip()),
        ("<div class='ad'>unclosed<article><p>a</p></article>", "a"),
        ("<p>a &lt; b < c &amp; d", "a < b < c & d"),
        ("<script>if (a < b) '</p>'</SCRIPT >x<style>p{}", "x"),
        ("<p>x <![CDATA[y]]> z", "x y z"),
        ("<form><article><p>Body.</p></article><input></form>", "Body."),
        (f"<body><form action='/x'><div class='post'><p>{LONG * 3}</p></div><nav>Home</nav></form></body>", (LONG * 3).strip()),
        (f"<form><p>Your name</p></form><div><p>{LONG * 3}</p></div>", (LONG * 3).strip()),
        (f"<div><p>Hi all.</p><p>{LONG}</p></div>", f"Hi all.\n\n{LONG.strip()}"),
        ("<div>" + "".join(f"<p>- Line {k}.</p>" for k in range(40)) + f"<p>{LONG}</p></div>", "\n\n".join([*(f"- Line {k}." for k in range(40)), LONG.strip()])),
        (f"<div class='post'><section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section><p class='alert'>Mind the gap.</p><div class='search'><p>We {LONG}</p></div></div>", f"Discussion\n\n{LONG.strip()}\n\nMind the gap.\n\nWe {LONG.strip()}"),
        ("<article><p>a</p><section id='respond'><p>b</p></section></article>", "a\n\nb"),
        ("", ""),
        ("<", "<"),
        ("<!-- never closed <p>x", ""),
    ],
)
def test_pages(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("piece", ["<p data-x='a\"b>text ", '<div class=ad>x<p class="y" ', "<div class=ad>", "<a href='", "<script>", "<!--", '<p title="a>b<', "<article>", "</div>"])
def test_time_is_linear(piece):
    began = time.time()
    main_text(piece * 20_000)
    assert time.time() - began < 5


def test_nothing_but_listed_parts_is_dropped_from_articles():
    table = pq.read_table(f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/pages.parquet", columns=["html"])
    for html in table.column(0).to_pylist():
        inner = (html or "").partition("<article>")[2].partition("</article>")[0]
        assert main_text(html or "") == "\n\n".join(x.text for x in lines_of(inner) if not isinstance(x, Gap))


def furnished(rng):
    """A page of known text among furniture that the contract lists, with or without a wrapper, short lines first and in between."""
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(n))
    post = [words(rng.randint(1, 4)) for _ in range(rng.randint(0, 4))] + [words(rng.randint(25, 60)) for _ in range(rng.randint(1, 4))]
    rng.shuffle(post)
    inside = [f"<p>{p}</p>" for p in post]
    for part in rng.sample([f"<aside>{words(5)}</aside>", f"<form>{words(4)}<input></form>", f"<div class='ad'><p>{words(30)}</p></div>", "<script>x < y</script>", f"<div id='comments'><h2>{words(2)}</h2><p>{words(9)}</p></div>"], rng.randint(0, 3)):
        inside.insert(rng.randint(0, len(inside)), part)
    tag = rng.choice(["article", "main", "div class='post'"])
    body = f"<header><h1>{words(3)}</h1></header><nav><a href='/'>{words(2)}</a></nav><{tag}>{''.join(inside)}</{tag.split()[0]}><footer>{words(6)}</footer>"
    wrap = rng.choice(["{}", "<form>{}</form>", "<div id='page'>{}</div>"])
    return f"<html><head><title>{words(4)}</title></head><body>{wrap.format(body)}</body></html>", post


def test_known_articles_among_known_furniture():
    rng = random.Random(11)
    for _ in range(400):
        html, post = furnished(rng)
        assert main_text(html) == "\n\n".join(post), html
