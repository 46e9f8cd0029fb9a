"""Ratcliff-Obershelp similarity of many pairs of texts at once.

The score of two texts is twice the number of matching characters over both lengths. Matching characters are those of the longest common block, the
earliest in the first text and then in the second, and, again, of what lies left and right of it in both. All pairs of a batch take each step of
that recursion together: the open segments are padded into a few tables of alike sizes, and one pass over the rows of a table finds the longest block of every
segment. In a second text of `CROWDED` characters and more, characters that are more than one in a hundred (and one) start no block, they only lengthen one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Fixed value: the length from which frequent characters start no block.
CROWDED = 200
#: Cells of a table of segments.
CELLS = 1 << 20


def _pool(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, and where each starts and ends."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    pool = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return pool, np.r_[0, ends].astype(np.int64)[: len(texts)], ends


def _crowds(pool: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True for the characters that may start no block."""
    out = np.zeros(len(pool), bool)
    for s, e in zip(start.tolist(), end.tolist()):
        if e - s >= CROWDED:
            _, which, n = np.unique(pool[s:e], return_inverse=True, return_counts=True)
            out[s:e] = n[which] > (e - s) // 100 + 1
    return out


def _longest(a: np.ndarray, b: np.ndarray, b_key: np.ndarray, lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, size) of each segment's longest block. b_key: b, but -1 where no block starts."""
    n, wide_a, wide_b = len(lo_a), int((hi_a - lo_a).max()), int((hi_b - lo_b).max())
    j = np.arange(wide_b)
    at_b = lo_b[:, None] + j
    row = np.where(at_b < hi_b[:, None], b_key[np.minimum(at_b, len(b) - 1)], -1)
    run, every = np.zeros((n, wide_b + 1), np.int32), np.arange(n)
    size, end_a, end_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(wide_a):
        at_a = lo_a + i
        char = np.where(at_a < hi_a, a[np.minimum(at_a, len(a) - 1)], -2)
        run[:, 1:] = np.where(row == char[:, None], run[:, :-1] + 1, 0)
        first = run[:, 1:].argmax(1)
        most = run[every, first + 1]
        better = most > size
        size[better], end_a[better], end_b[better] = most[better], i + 1, first[better] + 1
    return lo_a + np.where(size > 0, end_a - size, 0), lo_b + np.where(size > 0, end_b - size, 0), size


def _lengthened(a, b, lo_a, hi_a, lo_b, hi_b, i, j, size) -> None:
    """Grows blocks, in place, by equal characters before and after them, frequent ones too."""
    while True:
        at = np.flatnonzero((i > lo_a) & (j > lo_b))
        at = at[a[i[at] - 1] == b[j[at] - 1]]
        if not len(at):
            break
        i[at], j[at], size[at] = i[at] - 1, j[at] - 1, size[at] + 1
    while True:
        at = np.flatnonzero((i + size < hi_a) & (j + size < hi_b))
        at = at[a[(i + size)[at]] == b[(j + size)[at]]]
        if not len(at):
            break
        size[at] += 1


def matching(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """Number of matching characters of each pair."""
    (a, lo_a, hi_a), (b, lo_b, hi_b) = _pool(first), _pool(second)
    crowd = _crowds(b, lo_b, hi_b)
    b_key, crowded = np.where(crowd, -1, b), bool(crowd.any())
    total, open_ = np.zeros(len(first), np.int64), np.stack([np.arange(len(first)), lo_a, hi_a, lo_b, hi_b])
    while True:
        open_ = open_[:, (open_[1] < open_[2]) & (open_[3] < open_[4])]
        if not open_.shape[1]:
            return total
        wide_a, wide_b = (np.frexp(open_[k + 1] - open_[k])[1].astype(np.int64) for k in (1, 3))
        kind = wide_a * 64 + wide_b
        order = np.argsort(kind, kind="stable")
        edges_of_kinds = np.flatnonzero(np.diff(kind[order], prepend=-1))
        following = []
        tables = [(order[x:y], int(wide_b[order[x]])) for x, y in zip(edges_of_kinds, np.r_[edges_of_kinds[1:], len(order)])]
        for some in [t[k : k + max(1, CELLS >> w)] for t, w in tables for k in range(0, len(t), max(1, CELLS >> w))]:
            pair, *edges = open_[:, some]
            i, j, size = _longest(a, b, b_key, *edges)
            if crowded:
                _lengthened(a, b, *edges, i, j, size)
            np.add.at(total, pair, size)
            met = size > 0
            pair, i, j, size, (x, y, u, v) = pair[met], i[met], j[met], size[met], [e[met] for e in edges]
            following += [np.stack([pair, x, i, u, j]), np.stack([pair, i + size, y, j + size, v])]
        open_ = np.concatenate(following, axis=1)


def ratios(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """Score of each pair, from 0 to 1; two empty texts score 1."""
    both = np.array([len(x) + len(y) for x, y in zip(first, second)], np.int64)
    return np.where(both > 0, 2.0 * matching(first, second) / np.maximum(both, 1), 1.0) if len(both) else np.zeros(0)
