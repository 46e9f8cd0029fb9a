"""SimHash near-duplicate classes: byte-position inverted index with count filtering.

Fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they share at least 4
positional bytes. The index posts every distinct fingerprint under combinations of positional bytes, chosen so that
any 4 of the 8 positions contain one of them; pairs that meet in a posting list are kept when they share the
guaranteed number of positional bytes, then verified bit by bit. Longer combinations are chosen for more
fingerprints, so that posting lists stay short at any size.

Defined cases: null and empty texts (and texts of white space only) have fingerprint 0 and are linked like any other;
a text of fewer words than a shingle is one shingle; repeated rows and ties share a class; null ids
get a class but never name one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import as_bytes, batch_of, connected_components, stored

BYTES = 8


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of `size` of the 8 byte positions such that any 4 positions contain one of them."""
    a, b, c = (0, 1, 2), (3, 4, 5), (6, 7)
    if size == 1:
        return [(p,) for p in range(5)]
    if size == 2:
        return [x for group in (a, b, c) for x in combinations(group, 2)]
    if size == 3:
        inside = [x for group in (a, b, c) for x in combinations(group, 3)]
        return inside + [(*two, one) for g, h in ((a, b), (b, c), (c, a)) for two in combinations(g, 2) for one in h]
    return list(combinations(range(BYTES), 4))


def fingerprint(text: bytes, words: int = 4) -> int:
    w = text.lower().split()
    if not w:
        return 0
    xx = xxhash.xxh64_intdigest
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    h = np.array([xx(s, 42) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): SimHash over XXH64 (seed 42) of the word shingles; text does not leave its task."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in as_bytes(b.column(1))], np.uint64)
            yield batch_of(out, b.column(0).cast(pa.int64()), fps.view(np.int64))

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _forest(fp: np.ndarray, block: np.ndarray, bits: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints of equal block. fp, block: one entry per posting."""
    order = np.lexsort((fp, block))
    fp, block = fp[order], block[order]

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = fp[i] ^ fp[j]
        kept = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1) >= need
        kept[kept] = np.bitwise_count(x[kept]) <= bits
        return kept

    return spanning(fp, block, alike)


def spanning(node: np.ndarray, block: np.ndarray, alike) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of equal block that alike(positions, positions) accepts. node, block: one entry per posting, in order of block."""
    nodes, at = np.unique(node, return_inverse=True)
    label, parent = at.copy(), np.arange(len(nodes))
    out_a, out_b = [], []
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ends = np.repeat(np.r_[start[1:], len(block)], np.diff(np.r_[start, len(block)]))
    live, lag = np.arange(len(block)), 1
    while True:
        live = live[live + lag < ends[live]]
        if not len(live):
            break
        i, j = live, live + lag
        unlike = label[i] != label[j]
        i, j = i[unlike], j[unlike]
        near = alike(i, j)
        i, j = i[near], j[near]
        joined = False
        for p, q in zip(at[i].tolist(), at[j].tolist()):
            a, b = p, q
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[max(a, b)] = min(a, b)
                out_a.append(p)
                out_b.append(q)
                joined = True
        if joined:
            root = parent.copy()
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            parent, label = root, root[at]
        lag += 1
    return nodes[np.array(out_a, np.int64)], nodes[np.array(out_b, np.int64)]


#: Posting lists longer than a tile are broadcast (key and tiles, some 30 bytes each) up to this many; beyond it they are joined.
BROADCAST_LISTS = 200_000


def dealt(posts: DataFrame, on: list[str], node: str, tile: int, broadcast_lists: int = BROADCAST_LISTS) -> DataFrame:
    """(node, block) of the posts whose list `on` has another one: a list up to `tile` long is a block, a longer one is dealt into
    tiles, and each pair of tiles is a block. Lists are counted with partial sums first, and long ones are dealt where their posts lie, so
    that no task holds a whole hot list and no pair is lost."""
    counted = stored(posts.groupBy(*on).agg(F.count("*").alias("__n")).filter("__n > 1"))
    whole, long = counted.filter(F.col("__n") <= tile).select(*on), counted.filter(F.col("__n") > tile).select(*on, F.ceil(F.col("__n") / tile).cast("int").alias("__tiles"))
    lists = long.count()
    small = F.broadcast(long) if lists <= broadcast_lists else long
    rest = posts.join(small.select(*on), on, "left_anti") if lists else posts
    out = rest.join(whole, on).select(node, F.xxhash64(*on, F.lit(0), F.lit(0)).alias("block"))
    if not lists:
        return out
    own, other = F.pmod(F.xxhash64(node), F.col("__tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1))
    many = posts.join(small, on).select(node, *on, own.alias("__own"), other.alias("__other"))
    return out.unionByName(many.select(node, F.xxhash64(*on, F.least("__own", "__other"), F.greatest("__own", "__other")).alias("block")))


def links(distinct: DataFrame, n: int, bits: int = 4, tile: int = 8192, bucket_rows: int = 200_000, broadcast_lists: int = BROADCAST_LISTS) -> DataFrame:
    """(a, b): links that connect exactly what all links within `bits` bits connect. distinct: column fp, n rows."""
    need = BYTES - bits
    size = min(4, max(1, math.ceil(math.log(max(2, n) / 64, 256))))
    sets = position_sets(size)
    masks = [sum(0xFF << (8 * p) for p in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posts = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(signed)])).alias("x")).select("fp", "x.k", "x.v")
    lists = dealt(posts, ["k", "v"], "fp", tile, broadcast_lists)
    buckets = max(1, math.ceil(n * len(sets) / bucket_rows))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        a, b = _forest(fp, t.column("block").to_numpy().astype(np.int64), bits, need)
        return pa.Table.from_batches([batch_of(out, a.view(np.int64), b.view(np.int64))], out)

    return lists.withColumn("bucket", F.pmod("block", F.lit(buckets))).groupBy("bucket").applyInArrow(run, "a long, b long")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (long), fingerprint (hex), component_id (smallest doc_id reachable over links)."""
    fps = stored(fingerprints(docs, id_col, text_col, words))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(distinct.select("fp"), distinct.count(), bits))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """The documents that stay, in their own columns: of each class those with its smallest id, exact repeats of a row's id and text once.

    Rows that share an id stay or go together; rows with null ids stay, as no id tells them.
    """
    classes = simhash_classes(docs, id_col, text_col, words, bits).select("doc_id", "component_id")
    kept = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    named = docs.join(kept, docs[id_col] == kept["__keep"]).select(docs["*"]).dropDuplicates([id_col, text_col])
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
