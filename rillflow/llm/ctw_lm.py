"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision (a node of the byte's binary tree) has its own tree of contexts, the bytes before
it up to `depth`. Every context keeps Krichevsky-Trofimov counts, and a context's weight between its own estimate and its
longer contexts follows from all training text: log Pw = log(Pe / 2 + product of the longer contexts' Pw / 2). The probability of a
text mixes the estimates of all depths by these weights; a context that training never met predicts like the longest one met.

What is modelled is the token sequence: A-Z in lower case, words of non-space bytes with one space between them, then an end.
Counts of byte strings and of words are sums over all training documents. They are summed and answered in buckets:
each batch of documents sends its distinct strings once, with their counts, and gets back a probability for each; a bucket
holds all contexts that end in the same two bytes, and what is above them (at most 256 contexts, 65,280 nodes, whatever the
corpus) is summed for the driver.

Defined cases: null and empty texts are an end token only; null ids count as the empty text in the fold; repeated rows are scored and learnt
each; with nothing to learn from every decision has probability 1/2; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import LOWER, as_bytes, batch_of, dealt, parted, slices_of, stored, text_bytes, word_lists

DEPTH = 5
END = b"\xff"  # never part of UTF-8
GRAMS, TOKENS = 0, 1


def held_out(ids: list, folds: int = 7, fold: int = 2) -> np.ndarray:
    return np.array([zlib.crc32(str("" if i is None else i).encode()) % folds == fold for i in ids], bool)


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(key, text number) at every byte of the token sequences and at their ends.

    A key holds the context from the nearest byte on and the byte itself in its last place, so that a context's
    prefix of d bytes is its context of depth d.
    """
    runs = [b" ".join(t.lower().split()) + END for t in texts]
    raw = np.frombuffer((END * depth).join([b"", *runs]) + bytes(8), np.uint8) if runs else np.zeros(8, np.uint8)
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    v = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))[: max(0, len(raw) - 8 - depth)] & np.uint64((1 << 8 * (depth + 1)) - 1)
    pad = (np.cumsum(size + depth) - size - depth)[1:]  # where a later text's padding would be read as text
    kept = np.ones(len(v), bool)
    for k in range(depth):
        kept[pad - k - 1] = False
    v = v[kept]
    return ((v & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8)) | (v >> np.uint64(8 * depth)), np.repeat(np.arange(len(runs), dtype=np.int32), size)


def _bucket_of_grams(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    ends = keys >> np.uint64(8 * (depth - 1))
    return (((ends * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _bucket_of_words(words: list[str], buckets: int) -> np.ndarray:
    return (pd.util.hash_array(np.array(words, object), categorize=False) % np.uint64(buckets)).astype(np.int64) if words else np.empty(0, np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight up."""
    x = np.asarray(x, np.float64)
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


class Tree:
    """All nodes of depth `top` and more for a set of keys with counts: per depth and bit, sorted node keys with counts and weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top, self.levels = depth, top, {}
        below: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in range(depth, top - 1, -1):
            pair = ((keys >> np.uint64(8 * (depth - d + 1))) << np.uint64(8)) | (keys & np.uint64(255))
            if d < depth:
                order = np.argsort(pair, kind="stable")
                pair, n = pair[order], counts[order]
            else:
                n = counts
            at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
            pair, n = pair[at], np.add.reduceat(n, at) if len(at) else n
            above: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for k in range(8):
                node = ((pair >> np.uint64(8)) << np.uint64(8)) | np.uint64(1 << k) | ((pair & np.uint64(255)) >> np.uint64(8 - k))
                one = (pair >> np.uint64(7 - k)) & np.uint64(1)
                at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, np.int64)
                n1 = np.add.reduceat(n * one.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
                n0 = (np.add.reduceat(n, at) if len(at) else np.empty(0, np.int64)) - n1
                node = node[at]
                pe = log_kt(n0, n1)
                if d == depth:
                    pw, weight = pe, np.ones(len(node))
                else:
                    child, child_pw = below[k]
                    up = np.searchsorted(node, (child >> np.uint64(16) << np.uint64(8)) | (child & np.uint64(255)))
                    product = np.bincount(up, child_pw, len(node))
                    pw = np.logaddexp(pe, product) - math.log(2)
                    weight = np.exp(pe - math.log(2) - pw)
                self.levels[d, k] = (node, n0, n1, weight)
                above[k] = (node, pw)
            below = above
        self.roots = below  # of depth `top`, for what is above

    def mixed(self, keys: np.ndarray, k: int, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability that bit k of each key is 1, by the contexts from `depth` up to `top`; and where any was met (else guess stays)."""
        p, met = guess.copy(), np.zeros(len(keys), bool)
        x = keys & np.uint64(255)
        v = np.uint64(1 << k) | (x >> np.uint64(8 - k))
        for d in range(self.depth, self.top - 1, -1):
            node, n0, n1, weight = self.levels[d, k]
            if not len(node):
                continue
            want = ((keys >> np.uint64(8 * (self.depth - d + 1))) << np.uint64(8)) | v
            at = np.searchsorted(node, want)
            at[at == len(node)] = 0
            hit = node[at] == want
            at = at[hit]
            kt = (n1[at] + 0.5) / (n0[at] + n1[at] + 1.0)
            w = np.where(met[hit], weight[at], 1.0)  # nothing longer was met: its own estimate
            p[hit] = w * kt + (1 - w) * p[hit]
            met |= hit
        return p, met


class Top:
    """Contexts of depth 0 and 1: dense arrays over (depth, context byte, node)."""

    def __init__(self, n: np.ndarray, pw2: np.ndarray):
        """n: (256, 256, 2) counts of nodes by context byte; pw2: (256, 256) sums of log Pw of their longer contexts."""
        n1 = n.astype(np.float64)
        pe1 = log_kt(n1[..., 0], n1[..., 1])
        pw1 = np.where(n1.sum(-1) > 0, np.logaddexp(pe1, pw2) - math.log(2), 0.0)
        n0 = n1.sum(0)
        pe0 = log_kt(n0[..., 0], n0[..., 1])
        pw0 = np.where(n0.sum(-1) > 0, np.logaddexp(pe0, pw1.sum(0)) - math.log(2), 0.0)
        self.kt = [(n0[..., 1] + 0.5) / (n0.sum(-1) + 1), (n1[..., 1] + 0.5) / (n1.sum(-1) + 1)]
        self.weight = [np.exp(np.minimum(0, pe0 - math.log(2) - pw0)), np.exp(np.minimum(0, pe1 - math.log(2) - pw1))]
        self.met = [n0.sum(-1) > 0, n1.sum(-1) > 0]

    def mixed(self, context: np.ndarray, v: np.ndarray, p: np.ndarray, met: np.ndarray) -> np.ndarray:
        for kt, weight, seen in ((self.kt[1][context, v], self.weight[1][context, v], self.met[1][context, v]), (self.kt[0][v], self.weight[0][v], self.met[0][v])):
            w = np.where(met, weight, 1.0)
            p = np.where(seen, w * kt + (1 - w) * p, p)
            met = met | seen
        return p


def log10_probability(keys: np.ndarray, tree: Tree, top: Top) -> np.ndarray:
    """log10 P(byte | context) of each key."""
    out = np.zeros(len(keys))
    x = (keys & np.uint64(255)).astype(np.int64)
    near = ((keys >> np.uint64(8 * tree.depth)) & np.uint64(255)).astype(np.int64)
    for k in range(8):
        p, met = tree.mixed(keys, k, np.full(len(keys), 0.5))
        p = top.mixed(near, (1 << k) | (x >> (8 - k)), p, met)
        out += np.log10(np.where((x >> (7 - k)) & 1 == 1, p, 1 - p))
    return out


def _chunks(t: pa.Table):
    """(first row, ids, texts) in bounded pieces, rows in id order and equal rows side by side."""
    t = t.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
    if not t.num_rows:
        return
    ids = t.column("id").to_pylist()
    texts = t.column("text").chunk(0)
    for at, rows in slices_of(texts, 4_000_000):
        yield ids[at : at + len(rows)], rows


def _distinct(t: pa.Table, depth: int, keep: list | None = None):
    """Sorted distinct keys and words of a batch, with their counts in its training rows; and the number of those rows.

    keep, if given, gets what scoring needs of each piece: ids, its distinct keys, how often each stands in sorted order and in which
    text, and its words.
    """
    keys, counts, words, docs = [], [], {}, 0
    for ids, rows in _chunks(t):
        teach = ~held_out(ids)
        docs += int(teach.sum())
        key, text = grams(as_bytes(rows), depth)
        if keep is None:  # counts only: plain sorts
            for taught, some in ((1, key[teach[text]]), (0, key[~teach[text]])):
                some = np.sort(some)
                at = np.flatnonzero(np.r_[True, some[1:] != some[:-1]]) if len(some) else np.empty(0, np.int64)
                keys.append(some[at])
                counts.append(np.diff(np.r_[at, len(some)]) * taught)
        else:
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            keys.append(key[at])
            counts.append(np.zeros(len(at), np.int64))
        met, which, per_text = word_lists(rows, LOWER)
        n = np.bincount(which, np.repeat(teach, per_text), len(met)).astype(np.int64)
        for w, c in zip(met, n.tolist()):
            words[w] = words.get(w, 0) + c
        if keep is not None:
            keep.append((ids, key[at], np.diff(np.r_[at, len(key)]).astype(np.int32), text[order], met, which, per_text))
    key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    n = np.add.reduceat(np.concatenate(counts)[order], at) if len(at) else np.empty(0, np.int64)
    return key[at], n, words, docs


def _split(key: np.ndarray, words: list[str], depth: int, buckets: int):
    """What goes to each bucket, in an order that the answer keeps: (bucket, kind, places)."""
    for kind, where in ((GRAMS, _bucket_of_grams(key, depth, buckets)), (TOKENS, _bucket_of_words(words, buckets))):
        order = np.argsort(where, kind="stable")
        cut = np.flatnonzero(np.r_[True, where[order][1:] != where[order][:-1]]) if len(order) else np.empty(0, np.int64)
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            yield int(where[order[i]]), kind, order[i:j]


TOLD = "bucket int, part int, kind int, keys binary, counts binary"


def _tell(depth: int, buckets: int):
    out = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        key, n, words, docs = _distinct(t, depth)
        names, times = list(words), np.fromiter(words.values(), np.int64, len(words))
        rows = []
        for bucket, kind, at in _split(key, names, depth, buckets):
            if kind == GRAMS:
                sent = key[at]
                blob = np.diff(sent, prepend=np.uint64(0)).astype("<u8").tobytes()  # steps between sorted keys compress well
                rows.append((bucket, part, kind, blob, n[at].astype("<u4").tobytes()))
            else:
                rows.append((bucket, part, kind, b" ".join(names[i].encode() for i in at.tolist()), times[at].astype("<u4").tobytes()))
        rows.append((0, part, 2, b"", np.array([docs], "<u4").tobytes()))
        return pa.Table.from_batches([batch_of(out, *[list(c) for c in zip(*rows)])], out)

    return run


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "<u8").astype(np.uint64), dtype=np.uint64)


def _summed(t: pa.Table):
    """Keys and words of a bucket with their counts over all batches (training rows only)."""
    key, n, words = [], [], {}
    for kind, k, c in zip(t.column("kind").to_pylist(), t.column("keys").to_pylist(), t.column("counts").to_pylist()):
        c = np.frombuffer(c, "<u4").astype(np.int64)
        if kind == GRAMS:
            used = c > 0
            key.append(_keys(k)[used])
            n.append(c[used])
        elif kind == TOKENS:
            for w, x in zip(k.split(b" "), c.tolist()):
                if x:
                    words[w] = words.get(w, 0) + x
    key, n = (np.concatenate(key), np.concatenate(n)) if key else (np.empty(0, np.uint64), np.empty(0, np.int64))
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n[:0], words


def _above(depth: int):
    """Per bucket: sums over its two-byte contexts for each context byte and node above, and the numbers of its words."""
    out = pa.schema([("context", pa.int32()), ("node", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64()), ("pw", pa.float64())])

    def run(t: pa.Table) -> pa.Table:
        key, n, words = _summed(t)
        docs = sum(int(np.frombuffer(c, "<u4")[0]) for k, c in zip(t.column("kind").to_pylist(), t.column("counts").to_pylist()) if k == 2)
        rows = [batch_of(out, [-1], [0], [sum(words.values())], [len(words)], [0.0]), batch_of(out, [-1], [1], [docs], [0], [0.0])]
        if len(key):
            tree = Tree(key, n, depth, 2)
            for k in range(8):
                node, n0, n1, _ = tree.levels[2, k]
                pw = tree.roots[k][1]
                up = ((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255))  # contexts of depth 1 with their node
                only, at = np.unique(up, return_inverse=True)
                rows.append(batch_of(out, (only >> np.uint64(8)).astype(np.int32), (only & np.uint64(255)).astype(np.int32), np.bincount(at, n0).astype(np.int64), np.bincount(at, n1).astype(np.int64), np.bincount(at, pw)))
        return pa.Table.from_batches(rows, out)

    return run


def _reply(depth: int, top: Top):
    out = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("found", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        key, n, words = _summed(t)
        tree = Tree(key, n, depth, 2)
        asked = [_keys(k) for kind, k in zip(t.column("kind").to_pylist(), t.column("keys").to_pylist()) if kind == GRAMS]
        every = np.unique(np.concatenate(asked)) if asked else np.empty(0, np.uint64)
        logs = np.concatenate([log10_probability(every[i : i + 500_000], tree, top) for i in range(0, len(every), 500_000)]) if len(every) else np.empty(0)
        rows = []
        for part, bucket, kind, k in zip(t.column("part").to_pylist(), t.column("bucket").to_pylist(), t.column("kind").to_pylist(), t.column("keys").to_pylist()):
            if kind == GRAMS:
                rows.append((part, bucket, kind, logs[np.searchsorted(every, _keys(k))].astype("<f4").tobytes()))
            elif kind == TOKENS:
                rows.append((part, bucket, kind, np.array([words.get(w, 0) for w in k.split(b" ")], "<i8").tobytes()))
        return pa.Table.from_batches([batch_of(out, *([list(c) for c in zip(*rows)] or [[]] * 4))], out)

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(depth: int, buckets: int, tokens: int, kinds: int, ends: int):
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    total, below = tokens + ends, tokens + ends + kinds + (ends > 0) + 1

    def run(part, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return out.empty_table()
        pieces: list = []
        key, _, words, _ = _distinct(docs, depth, pieces)
        names = list(words)
        logs, seen = np.zeros(len(key)), np.zeros(len(names), np.int64)
        found = {(b, k): f for b, k, f in zip(replies.column("bucket").to_pylist(), replies.column("kind").to_pylist(), replies.column("found").to_pylist())}
        for bucket, kind, at in _split(key, names, depth, buckets):
            if kind == GRAMS:
                logs[at] = np.frombuffer(found[bucket, kind], "<f4")
            else:
                seen[at] = np.frombuffer(found[bucket, kind], "<i8")
        times = dict(zip(names, seen.tolist()))
        rows = []
        for ids, only, often, text, met, which, per_text in pieces:
            score = np.bincount(text, np.repeat(logs[np.searchsorted(key, only)], often), len(ids))
            c = np.fromiter((times[w] for w in met), np.int64, len(met))[which]
            owner = np.repeat(np.arange(len(ids)), per_text)
            known = np.bincount(owner, c > 0, len(ids)).astype(np.int64) + (ends > 0)
            base = np.bincount(owner, np.log10((c + 1) / below), len(ids)) + math.log10((ends + 1) / below)
            rows.append(batch_of(out, ids, held_out(ids), per_text + 1, known, np.full(len(ids), total), base, score))
        return pa.Table.from_batches(rows, out)

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, part_bytes: int = 14 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    n_bytes = text_bytes(docs, text_col)
    buckets = min(65_536, max(1, math.ceil(n_bytes / bucket_bytes)))
    parts = max(1, math.ceil(n_bytes / part_bytes))
    # Order is free here, so that neither null nor repeated ids fill a part.
    base = parted(docs, id_col, text_col, F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)).cast("int"), parts)
    told = stored(base.groupBy("part").applyInArrow(_tell(depth, buckets), TOLD))
    above = told.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_above(depth), "context int, node int, n0 long, n1 long, pw double")
    n, pw, tokens, kinds, ends = np.zeros((256, 256, 2), np.int64), np.zeros((256, 256)), 0, 0, 0
    for r in above.groupBy("context", "node").agg(F.sum("n0"), F.sum("n1"), F.sum("pw")).collect():  # at most 65,282 rows
        if r[0] >= 0:
            n[r[0], r[1]], pw[r[0], r[1]] = (r[2], r[3]), r[4]
        elif r[1] == 0:
            tokens, kinds = r[2], r[3]
        else:
            ends = r[2]
    replies = told.filter("kind < 2").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_reply(depth, Top(n, pw)), "part int, bucket int, kind int, found binary")
    return base.groupBy("part").cogroup(dealt(replies, parts, "part").groupBy("part")).applyInArrow(_score(depth, buckets, int(tokens), int(kinds), int(ends)), RESULT)
