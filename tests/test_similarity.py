"""The pairwise similarity against the standard library's matcher, one pair at a time."""

import random
from difflib import SequenceMatcher

import pytest

from rillflow.functions.similarity import CROWDED, matching, ratios


def plain(first, second):
    return [SequenceMatcher(None, x, y).ratio() for x, y in zip(first, second)]


def texts(seed, n, letters, least, most):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(least, most))) for _ in range(n)]


@pytest.mark.parametrize("letters", ["ab", "abcde fg", "abcdefghijklmnopqrstuvwxyz é日𝒳"])
def test_ten_thousand_random_pairs(letters):
    a, b = texts(1, 10_000, letters, 0, 40), texts(2, 10_000, letters, 0, 40)
    b = [x[:5] + y[:3] + x[7:] if k % 3 == 0 else y for k, (x, y) in enumerate(zip(a, b))]
    assert ratios(a, b).tolist() == plain(a, b)


def test_ties_take_the_earliest_block():
    a = ["abxcdyab", "aaa", "abcabc", "xaybxa", "", "", "a", "tide", "qabxcd", " abcd"]
    b = ["abzcd", "aa", "cab", "xaxbya", "", "a", "a", "diet", "abycdf", "abcd abcd"]
    assert ratios(a, b).tolist() == plain(a, b)
    assert matching([], []).tolist() == [] and ratios([], []).tolist() == []


def test_frequent_characters_of_long_texts():
    a, b = texts(3, 120, "abcdef", 150, 420), texts(4, 120, "abcdef", 150, 420)
    many = "".join(map(chr, range(33, 290)))
    a += texts(5, 80, many * 2 + "ab" * 40, CROWDED - 2, CROWDED + 60)
    b += [x[:90] + "ab" * 30 + x[95:] for x in a[120:]]
    assert ratios(a, b).tolist() == plain(a, b)
