"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Every word gives its character n-grams, with marks at its ends; each n-gram has an embedding (hashed to a table),
a document is the average of all its n-grams' embeddings, and a two-class linear softmax reads that average.
Embeddings and softmax are learnt together, so misspellings and unseen inflections share what their n-grams have learnt.

Training takes a bounded sample of labelled rows: at most `max_docs` rows and `max_bytes` bytes of text, half of each kept for
toxic ones, in the order of a hash of id and text; weights restore the classes' shares. The sample's n-grams are counted where the texts
lie, so that the driver gets packed bags, four bytes an n-gram, and no texts. Scoring is linear in the n-grams, so the model that tasks
carry is one number for each table entry.

Defined cases: null and empty texts score like a text without n-grams (the prior); labels that are null, or rows whose label
is missing, teach nothing; rows of equal id, text and label teach once; repeated ids are scored row by row; with no labels of both classes
every score is the share of toxic labels (0 with none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import as_text, batch_of, lean, release, slices_of, stored, word_lists

MAX_DOCS, MAX_BYTES = 6000, 32 << 20
TABLE_BITS = 18
COUNT_BITS = 32 - TABLE_BITS
SIZES = (3, 4, 5, 6)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def ngrams(words: list[str], bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(table entry, word number) of every character n-gram of every word."""
    marked = [f"<{w.lower()}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the word's end
    entries, owners = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(SIZES) + 1):
        nxt = np.zeros(len(code), np.uint64)
        nxt[: max(0, len(code) - n + 1)] = code[n - 1 :]
        h = (h * np.uint64(0x100000001B3)) ^ (nxt + np.uint64(n))
        if n in SIZES:
            at = left >= n
            entries.append(((h[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64))
            owners.append(word[at])
    return np.concatenate(entries), np.concatenate(owners)


#: Words whose n-grams are held at once, some 200 bytes for each character.
WORDS_AT_ONCE = 4096


@dataclass
class Model:
    weight: np.ndarray  # log odds that one n-gram adds, times the scale
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, rows in slices_of(texts):
            met, which, per_text = word_lists(rows)
            total, count = self.of_words(met)
            text = np.repeat(np.arange(len(rows)), per_text)
            sums, n = np.bincount(text, total[which], len(rows)), np.bincount(text, count[which], len(rows))
            out[first : first + len(rows)] = sums / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the weights, and number, of each word's n-grams."""
        total, count = np.zeros(len(words)), np.zeros(len(words), np.int64)
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            entry, owner = ngrams(some)
            total[at : at + len(some)] = np.bincount(owner, self.weight[entry], len(some))
            count[at : at + len(some)] = np.bincount(owner, minlength=len(some))
        return total, count


def bag(text: str) -> bytes:
    """The distinct n-grams of a text, each as table entry and count (at most 2^COUNT_BITS - 1) in 32 bits."""
    met, which, _ = word_lists(pa.array([text], pa.string()))
    entry, owner = ngrams(met) if met else (np.empty(0, np.int64), np.empty(0, np.int64))
    used, at = np.unique(entry, return_inverse=True)
    n = np.bincount(at, np.bincount(which, minlength=len(met))[owner], len(used)).astype(np.int64)
    return ((used << COUNT_BITS) | np.minimum(n, (1 << COUNT_BITS) - 1)).astype("<u4").tobytes()


def train(bags: list[bytes], labels: np.ndarray, weights: np.ndarray, dims: int = 8, epochs: int = 8, rate: float = 0.3, scale: float = 60.0, decay: float = 0.001, shrink: float = 0.01, seed: int = 1) -> Model:
    """Stochastic gradient descent on embeddings and softmax together. N-grams of very few documents are left out; `shrink` keeps the rest small."""
    share = float((labels * weights).sum() / max(weights.sum(), 1e-9)) if len(labels) else 0.0
    if len(set(labels.tolist())) < 2:
        bounded = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(1 << TABLE_BITS), float(np.log(bounded / (1 - bounded))))
    docs, seen = [np.frombuffer(b, "<u4") for b in bags], np.zeros(1 << TABLE_BITS, np.int64)
    for d in docs:
        seen[d >> COUNT_BITS] += 1
    least_docs = max(3, min(20, len(docs) // 100))
    total = [max(1, int((d & ((1 << COUNT_BITS) - 1)).sum())) for d in docs]
    docs = [d[seen[d >> COUNT_BITS] >= least_docs] for d in docs]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (1 << TABLE_BITS, dims)).astype(np.float32)
    emb[seen < least_docs] = 0
    soft = rng.normal(0, 0.3, (2, dims)).astype(np.float32)
    bias = np.log(np.array([1 - share, share]) + 1e-6).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(docs)):
            g, x = docs[i] >> COUNT_BITS, (docs[i] & ((1 << COUNT_BITS) - 1)).astype(np.float32)
            x *= scale / total[i]
            held = emb[g]
            mean = x @ held
            z = soft @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            p *= weights[i]
            down = soft.T @ p
            d_soft = np.outer(p, mean)
            if len(g):
                held *= 1 - step * shrink
                held -= np.outer(x, step * down)
                emb[g] = held
            soft -= step * (d_soft + decay * soft)
            bias -= 0.1 * step * p
    return Model((emb @ (soft[1] - soft[0])).astype(np.float64) * scale, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """Learns from at most max_docs labelled rows and max_bytes bytes of text that `usable` (over the label table) allows; a text of more
    than an eighth of max_bytes teaches nothing.

    What reaches the driver: a hash, a label and a size for each row of the sample, then its bags.
    """
    usable = F.lit(True) if usable is None else usable
    known = labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.xxhash64(F.col(id_col), text).alias("own")
    # Texts stay where they are: hashes and sizes meet the labels, and the sample's hashes come back to the texts.
    rows = docs.select(F.col(id_col).alias("__id"), own, F.octet_length(text).cast("long").alias("size")).filter(F.col("size") <= max_bytes // 8)
    told = stored(rows.join(known, "__id").groupBy("own", "y").agg(F.max("size").alias("size")))
    sizes = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for y in sorted(sizes):
        first = told.filter(F.col("y") == y).orderBy(F.xxhash64("own", "y"), "own").limit(max_docs // 2).select("own", "size").collect()
        fits = int((np.cumsum([r["size"] for r in first]) <= max_bytes // 2).sum())
        chosen += [(r["own"], y) for r in first[:fits]]
    if not chosen:
        return train([], np.empty(0, np.int64), np.empty(0))
    sample = F.broadcast(docs.sparkSession.createDataFrame(chosen, "own long, y int"))  # at most max_docs rows
    some = docs.select(own, text.alias("__text")).join(sample, "own").groupBy("own", "y").agg(F.first("__text").alias("__text"))
    some = some.select(F.xxhash64("own", "y").alias("h"), "y", "__text")
    out = pa.schema([("h", pa.int64()), ("y", pa.int32()), ("bag", pa.binary())])

    @lean
    def bags(batches):
        for b in batches:
            yield batch_of(out, b.column(0), b.column(1), [bag(t) for t in as_text(b.column(2))])

    got = some.mapInArrow(bags, "h long, y int, bag binary").toArrow().sort_by("h")
    y = got.column("y").to_numpy().astype(np.int64)
    w = np.array([sizes.get(k, 0) / max(1, n) for k, n in enumerate(np.bincount(y, minlength=2))])[y]
    model = train(got.column("bag").to_pylist(), y, w / w.mean())
    del got
    release()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability of label 1 for each row. No shuffle."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    @lean
    def run(batches):
        for b in batches:
            yield batch_of(out, b.column(0).cast(pa.int64()), model.scores(b.column(1)))

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows that score `threshold` or more, in their own columns. No shuffle."""
    at = docs.columns.index(text_col)

    @lean
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
