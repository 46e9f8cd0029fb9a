"""Ranked search against scores of all pairs."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import LONG, rows

from rillflow.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, id long, n long, terms string, score int, rank int, item_id long, key string"
ITEMS = "item_id long, text string, key string, terms int, doc_id long"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 50 + (50 * c.total() * n_docs) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, k, **more):
    d = spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5, "k") for r in docs], DOCS).repartition(3)
    return rows(L.ranked(d, spark.createDataFrame([(*r, "k", 1, 2) for r in items], ITEMS), k, **more))


ODD = [(1, None), (2, ""), (3, " \t-"), (4, LONG), (5, LONG), (5, LONG), (6, "Word1 of THE é 日本"), (None, "the text the word2"), (None, "the text the word2"), (7, "word1 K İ x"), (8, "text"), (9, "text")]


def test_odd_rows(spark):
    items = [(1, "the Text of word1"), (2, None), (3, "..."), (4, "nowhere"), (5, "É é 日本 k"), (5, "text text TEXT"), (None, "text"), (6, LONG)]
    assert ranked(spark, ODD, items, 3) == plain(ODD, items, 3)
    assert ranked(spark, [], items, 3) == ranked(spark, ODD, [], 3) == ranked(spark, ODD[:3], items, 3) == []


@pytest.mark.parametrize("block_terms", [L.BLOCK_TERMS, 40])
def test_many_documents_and_ties(spark, block_terms):
    """A third of the documents is one text; words are frequent and rare; items in one block or in several."""
    word = lambda k: f"w{(k * k) % 97 % (5 + k % 60)}"
    docs = [(i, "same copy of w1 w2 w3" if i % 3 == 0 else " ".join(word(i * 7 + j * (1 + i % 5)) for j in range(3 + i % 40))) for i in range(900)]
    items = [(q, " ".join(word(q * 11 + j) for j in range(1 + q % 12))) for q in range(60)] + [(60, "same copy"), (60, "same copy")]
    assert ranked(spark, docs, items, 50, block_terms=block_terms) == plain(docs, items, 50)


def test_whole_batches_are_left_out():
    """Two languages that share no word: an item's pairs with the other language are never scored, and most of its own neither."""
    rng = np.random.default_rng(5)
    impacts = np.zeros((2048, 200), np.float32)
    for d in range(2048):
        impacts[d, rng.choice(100, 12, replace=False) + 100 * (d % 2)] = rng.integers(1, 900_000, 12)
    sets = [rng.choice(100, 6, replace=False) + 100 * (q % 2) for q in range(40)]
    weights = rng.integers(1, 9000, 200).astype(float)
    order = L.splitting_order(impacts > 0)
    best = L.Best(40, 10, np.zeros(40))
    scored = L.search(L.ItemTree(sets, weights), L.DocTree(impacts[order]), order, np.zeros(2048, bool), best)
    assert scored < 0.5 * 2048 * 40
    for q, s in enumerate(sets):
        whole = impacts[:, s].astype(float) @ weights[s]
        first = np.lexsort((np.arange(2048), -whole))[:10]
        assert best.found[q][1].tolist() == first.tolist() and best.found[q][0].tolist() == whole[first].tolist()
    again = L.search(L.ItemTree(sets, weights), L.DocTree(impacts[order][:64]), order[:64], np.zeros(64, bool), best)
    assert again < 64 * 40
