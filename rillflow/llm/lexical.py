"""Ranked lexical search by dual trees: the best documents of every item, exactly, without scoring all pairs.

Items are the stated query set; they are searched against all documents in blocks of about `BLOCK_TERMS` terms, so that what a task holds of
them is bounded. One pass over the texts leaves of each document its length and the counts of the block's terms; documents and frequencies
are counted from that, and the search reads it again, so texts are tokenised once a block and never shuffled.

A task reads `rows` documents at a time, orders them by the terms that split them best, so that alike ones stand together, and builds a tree over them;
the items have a tree of the same kind. A node holds for each term (coordinate) the greatest weight below it. The bound of two nodes is the sum over their terms
of the products; where it is below the weakest kth score of the items in the node, no pair below can enter any result, and the whole batch of pairs is
left out. Bounds and scores are sums of whole numbers under 2**53, so that pruning loses nothing. One sixty-fourth of the documents is searched first: the
kth scores there are bounds from which every task starts, so that few pairs but the final ones are shuffled. All documents are then searched.

Score: the sum over the item's distinct terms of w * ((1000000000 * tf) div (1000 * tf + 20 * m)), w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))),
m = 50 + (50 * n * N) div L; N counts the documents with terms, L all their terms, n one document's, df the documents holding a term, tf its
occurrences. Terms are maximal runs of 0-9, a-z (A-Z in lower case) and non-ASCII characters.

Defined cases: null and empty texts have no terms; an item without terms, or whose terms no document holds, has no rows; every item row is ranked, repeated ones
alike, and equal sets of terms are searched once; documents that are repeated are ranked each; equal scores stand by ascending id, null ids last; long texts are
read whole; an empty table gives an empty result; other columns, whatever their names, count for nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.common import batch_of, slices_of, stored, word_lists

#: Terms of the items that one pass searches, cells of a batch's table of weights, documents in a leaf, children of a node, share of the first search.
BLOCK_TERMS, CELLS, LEAF, FAN, FIRST = 200_000, 1 << 23, 16, 8, 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def term_sets(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, key, terms) of each item row that has terms; key stands for the set."""
    text = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))))
    return items.select(F.col(id_col).alias("item_id"), terms.alias("terms")).filter(F.size("terms") > 0).withColumn("key", F.sha2(F.array_join("terms", " "), 256))


def splitting_order(held: np.ndarray, most: int = 48) -> np.ndarray:
    """An order of rows that puts those together which share the columns that split them most evenly. held: rows x columns, true or false."""
    n = len(held)
    met = held.sum(0)
    gain = met * (n - met)
    best = np.argsort(-gain, kind="stable")[:most]
    return np.lexsort(held[:, best[::-1]].T) if len(best) else np.arange(n)


class ItemTree:
    """Nodes over the items, ordered by shared terms: for each its terms and their weights, its items and its children; leaves are items."""

    def __init__(self, sets: Sequence[np.ndarray], weights: np.ndarray):
        held = np.zeros((len(sets), len(weights)), bool)
        for k, s in enumerate(sets):
            held[k, s] = True
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]] = []
        level = []
        for k in splitting_order(held).tolist():
            level.append(self._add(sets[k], weights, np.array([k]), []))
        while len(level) > 1:
            level = [self._join(level[i : i + FAN], weights) for i in range(0, len(level), FAN)]
        self.root = level[0]

    def _add(self, terms, weights, items, children) -> int:
        self.nodes.append((terms, weights[terms], items, children))
        return len(self.nodes) - 1

    def _join(self, children: list[int], weights) -> int:
        if len(children) == 1:
            return children[0]
        terms = np.unique(np.concatenate([self.nodes[c][0] for c in children]))
        return self._add(terms, weights, np.concatenate([self.nodes[c][2] for c in children]), children)


class Best:
    """The best k documents of each item so far; `least` is what a score must reach."""

    def __init__(self, n_items: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.found = [(np.empty(0), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(n_items)]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        good = (scores >= self.least[item]) & (scores > 0)
        if not good.any():
            return
        s, i, g = (np.concatenate([a, b[good]]) for a, b in zip(self.found[item], (scores, ids, no_id)))
        first = np.lexsort((i, g, -s))[: self.k]
        self.found[item] = s[first], i[first], g[first]
        if len(first) == self.k:
            self.least[item] = max(self.least[item], s[first[-1]])


class DocTree:
    """A batch of documents: impacts (documents x terms), and from the leaves up the greatest impact of each term below each node."""

    def __init__(self, impacts: np.ndarray):
        self.impacts, self.levels = impacts, []
        top, width = impacts, LEAF
        while True:
            top = np.maximum.reduceat(top, np.arange(0, len(top), width), axis=0)
            self.levels.append(top)
            if len(top) == 1:
                break
            width = FAN

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Children of nodes; of leaves the documents."""
        width, n = (FAN, len(self.levels[level - 1])) if level else (LEAF, len(self.impacts))
        out = (nodes[:, None] * width + np.arange(width)).ravel()
        return out[out < n]


def search(items: ItemTree, docs: DocTree, ids: np.ndarray, no_id: np.ndarray, best: Best) -> int:
    """Adds the batch's documents that may be among the best of an item; returns how many pairs were scored."""
    scored = 0

    def bounds(node, level, nodes):
        terms, weights, *_ = items.nodes[node]
        return docs.levels[level][np.ix_(nodes, terms)].astype(np.float64) @ weights

    def score(node, leaves):
        nonlocal scored
        terms, weights, (item,), _ = items.nodes[node]
        rows = docs.below(0, leaves)
        scored += len(rows)
        best.add(item, docs.impacts[np.ix_(rows, terms)].astype(np.float64) @ weights, ids[rows], no_id[rows])

    def visit(node, level, nodes):
        _, _, own, children = items.nodes[node]
        most = bounds(node, level, nodes)
        kept = (most >= best.least[own].min()) & (most > 0)
        if not kept.any():
            return
        nodes, most = nodes[kept], most[kept]
        if level:
            visit(node, level - 1, docs.below(level, nodes))
        elif children:
            for c in children:
                visit(c, 0, nodes)
        else:  # the most promising leaves first: they raise what the others must reach
            order = np.argsort(-most, kind="stable")
            nodes, most = nodes[order], most[order]
            score(node, nodes[:FAN])
            rest = most[FAN:] >= best.least[own[0]]
            if rest.any():
                score(node, nodes[FAN:][rest])

    visit(items.root, len(docs.levels) - 1, np.array([0]))
    return scored


def _vectors(docs: DataFrame, id_col: str, text_col: str, number: dict[str, int]) -> DataFrame:
    """(id, n, terms, tfs): of each document its number of terms, and the counts of the numbered ones."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def count(batches):
        for b in batches:
            ids = b.column(0).cast(pa.int64())
            for at, texts in slices_of(b.column(1)):
                words, which, sizes = word_lists(texts)
                known = np.array([number.get(w, -1) for w in words], np.int64)
                term = known[which] if len(words) else np.empty(0, np.int64)
                row = np.repeat(np.arange(len(texts)), sizes)
                pairs, tf = np.unique((row * len(number) + term)[term >= 0], return_counts=True)
                ends = np.cumsum(np.bincount(pairs // max(1, len(number)), minlength=len(texts)))
                offsets = pa.array(np.r_[0, ends], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(number)), tf)]
                yield batch_of(out, ids.slice(at, len(texts)), sizes, *lists)

    return stored(docs.select(id_col, text_col).mapInArrow(count, "id long, n long, terms array<int>, tfs array<int>"))


def _found(vectors: DataFrame, items: ItemTree, n_items: int, n_terms: int, k: int, least: np.ndarray, n_docs: int, length: int) -> DataFrame:
    """(item, id, score): of each task the best documents."""
    out = pa.schema([("item", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
    rows = int(min(2048, max(64, CELLS // n_terms)))

    def find(batches):
        best = Best(n_items, k, least)
        for whole in batches:
            for b in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                ids, n, terms, tfs = b.columns
                sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), sizes)
                tf = tfs.flatten().to_numpy().astype(np.int64)
                m = 50 + 50 * n.to_numpy().astype(np.int64) * n_docs // length
                impacts = np.zeros((b.num_rows, n_terms), np.float32)  # below 2**20: whole numbers
                impacts[row, terms.flatten().to_numpy()] = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
                order = splitting_order(impacts > 0)
                search(items, DocTree(impacts[order]), ids.fill_null(0).to_numpy()[order], ids.is_null().to_numpy(zero_copy_only=False)[order], best)
        for item, (scores, ids, no_id) in enumerate(best.found):
            if len(scores):
                yield batch_of(out, pa.array(np.full(len(ids), item, np.int32)), pa.array(ids, mask=no_id), pa.array(scores.astype(np.int64)))

    return vectors.filter(F.size("terms") > 0).select("id", "n", "terms", "tfs").mapInArrow(find, "item int, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best documents."""
    spark = docs.sparkSession
    given = stored(term_sets(items, item_col, item_text))
    sets = stored(given.select("key", "terms").dropDuplicates(["key"]))
    blocks = max(1, -(-int(sets.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0) // block_terms))
    result = None
    for block in range(blocks):
        mine = sorted(sets.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect())
        if not mine:
            continue
        number = {t: i for i, t in enumerate(sorted({t for r in mine for t in r["terms"]}))}
        vectors = _vectors(docs, id_col, text_col, number)
        n_docs, length = vectors.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.zeros(len(number))
        for term, df in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        tree = ItemTree([np.array([number[t] for t in r["terms"]]) for r in mine], weights)
        least = np.zeros(len(mine))
        first = vectors.filter(F.pmod(F.xxhash64("id", "n"), F.lit(FIRST)) == 0)
        kth = W.partitionBy("item").orderBy(F.desc("score"))
        args = tree, len(mine), len(number), k
        for item, score in _found(first, *args, least, n_docs, length).withColumn("r", F.row_number().over(kth)).filter(F.col("r") == k).select("item", "score").collect():  # one an item
            least[item] = score
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = _found(vectors, *args, least, n_docs, length).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        keys = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(mine)], "item int, key string")
        best = best.join(F.broadcast(keys), "item").select("key", "rank", F.col("id").alias("doc_id"), "score")
        best = stored(best) if blocks > 1 else best
        result = best if result is None else result.unionByName(best)
    if result is None:
        result = given.select("key", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return given.select("item_id", "key").join(result, "key").select("item_id", "rank", "doc_id", "score")
