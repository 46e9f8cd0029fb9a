"""SimHash near-dedup for a Jaccard similarity: wide fingerprints, an inverted index over their byte positions, count filtering, exact check.

Texts are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. A fingerprint is SimHash's, each bit the
majority of its shingles' votes, but of 2,048 bits: two texts of similarity 0.8 differ in some 15 % of the bits, about 10 of 64, and need
not share one of the 8 bytes of a short fingerprint; of 256 bytes they share about 70. Texts are posted under pairs of byte
positions (128 of them; texts of similarity 0.8 share a pair with probability 0.08 each, and none of all with about 5e-5, very short ones up to 4e-4;
at 0.85 it is below 1e-6). Pairs of a posting list are kept when enough of 192 one-bit positions agree, and what is left is verified:
inside a candidate group shingle sets are compared pair by pair, except pairs that other links connect already.

Defined cases: words are divided by ASCII white space and lower-cased as bytes; a text of fewer words than a shingle is one shingle, null
and empty texts (and texts of white space only) are one empty shingle; rows are told apart by their text (its SHA-256), never by their id, so null and
repeated ids are judged like any other; an empty table gives an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import as_bytes, batch_of, connected_components, counted, gathered, lean, release, stored
from rillflow.llm.simhash import spanning

WORDS, SIMILARITY = 5, 0.8
#: Byte positions of a fingerprint, and pairs of them that are posted: posting lists number LISTS.
BYTES = 256
PAIRS = BYTES // 2
LISTS = PAIRS << 16
#: Votes of a shingle for each bit: with one, texts of very few shingles differ in more bits than their similarity asks for.
VOTES = 3
#: Words of 64 bits that a posting carries; of their 192 bits 28 to 31 differ on average at similarity 0.8 (standard deviation 5), 96 of unlike texts (7).
SKETCH, SKETCH_BITS = 3, 56
_RNG = np.random.default_rng(42)
TIMES = _RNG.integers(1, 1 << 63, VOTES * BYTES // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RNG.integers(0, 1 << 63, VOTES * BYTES // 8, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: So many shingles are counted in a byte for each bit.
AT_ONCE = 255 // VOTES


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct XXH64 hashes of a text's word shingles, in order; never empty."""
    w, xx = text.lower().split(), xxhash.xxh64_intdigest
    found = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.unique(np.array([xx(s, 42) for s in found], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The wide SimHash of a set of shingle hashes: BYTES bytes, each bit set if over half of the votes are."""
    ones = np.zeros(BYTES * 8, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        x = hashes[at : at + AT_ONCE, None] * TIMES + PLUS
        x ^= x >> np.uint64(29)
        x *= MIX
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, BYTES), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > VOTES * len(hashes))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row per distinct text, stored: sha (its digest), key (a number of its own), id (the smallest), n (rows), fp (its fingerprint); text does not leave its task."""
    out = pa.schema([("sha", pa.binary()), ("id", pa.int64()), ("fp", pa.binary())])

    @lean
    def run(batches):
        for b in batches:
            yield batch_of(out, b.column(0), b.column(1).cast(pa.int64()), [fingerprint(shingles(t, words)).tobytes() for t in as_bytes(b.column(2))])

    each = docs.select(digest_of(text_col).alias("sha"), id_col, text_col).mapInArrow(run, "sha binary, id long, fp binary")
    texts = each.groupBy("sha").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("fp").alias("fp"))
    return stored(texts.withColumn("key", F.monotonically_increasing_id()))  # stored, so that a text keeps its number


def digest_of(text_col: str):
    return F.unhex(F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256))


def tiled(df: DataFrame, large: DataFrame, on: str) -> DataFrame:
    """df with a block for each pair of tiles that its row belongs to. large: `on` and tiles of the groups of more than one tile; the others
    are one block each, so rows are dealt where they lie and shuffled by block only."""
    own = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    large = stored(large)
    if not large.count():
        return df.withColumn("block", F.xxhash64(on)).drop(on)
    dealt = df.join(counted(large), on, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.withColumn("block", F.xxhash64(on, F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other", "tiles", on)


def lists_of(fps: list[bytes]) -> np.ndarray:
    """The numbers of the posting lists of each fingerprint, one for each pair of byte positions."""
    return np.frombuffer(b"".join(fps), np.uint16).reshape(-1, PAIRS).astype(np.int64) + (np.arange(PAIRS) << 16)


def long_lists(texts: DataFrame, tile: int) -> DataFrame:
    """(list, tiles) of all posting lists of more than a tile. Lists are counted inside the tasks, and a task tells those that reach its share
    of a tile; lists that no task tells are no longer than a tile."""
    share = max(1, tile // max(1, texts.rdd.getNumPartitions()))
    out = pa.schema([("list", pa.int64()), ("n", pa.int64())])

    @lean
    def run(batches):
        n = np.zeros(LISTS, np.uint32)
        for b in batches:
            for fps in chunks(b.column(0).to_pylist()):
                np.add.at(n, lists_of(fps).ravel(), 1)
        told = np.flatnonzero(n > share)
        yield batch_of(out, told, n[told].astype(np.int64))

    told = texts.select("fp").mapInArrow(run, "list long, n long").groupBy("list").agg(F.sum("n").alias("n"))
    # What tasks did not tell of a list is less than a tile.
    return told.select("list", F.ceil((F.col("n") + tile) / tile).cast("int").alias("tiles"))


def chunks(values: list, most: int = 1000):
    return (values[at : at + most] for at in range(0, len(values), most))


def candidates(texts: DataFrame, n: int, tile: int = 8192, bucket_rows: int = 200_000) -> DataFrame:
    """(a, b): links that connect all texts which share a pair of bytes and have close one-bit positions. A list holds one of 65,536 texts."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    sketch = [f"s{k}" for k in range(SKETCH)]
    posted = pa.schema([(c, pa.int64()) for c in ("key", *sketch, "list")])

    @lean
    def split(batches):
        for b in batches:
            for some in chunks(list(zip(*(b.column(k).to_pylist() for k in (0, 1))))):
                fps = [fp for _, fp in some]
                head = np.array([np.frombuffer(fp, np.int64, SKETCH) for fp in fps])
                yield batch_of(posted, np.repeat(np.array([key for key, _ in some]), PAIRS), *[np.repeat(head[:, k], PAIRS) for k in range(SKETCH)], lists_of(fps).ravel())

    posts = texts.select("key", "fp").mapInArrow(split, ", ".join(f"{c} long" for c in posted.names))
    buckets = max(1, math.ceil(n * PAIRS / bucket_rows))

    def run(t: pa.Table) -> pa.Table:
        key, *bits, block = (t.column(c).to_numpy().astype(np.int64) for c in ("key", *sketch, "block"))
        order = np.lexsort((*bits[::-1], block))
        key, bits, block = key[order], [s[order].view(np.uint64) for s in bits], block[order]
        a, b = spanning(key, block, lambda i, j: sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int64) for s in bits) <= SKETCH_BITS)
        release()
        return pa.Table.from_batches([batch_of(out, a, b)], out)

    # No list is longer than all texts together.
    dealt = tiled(posts, long_lists(texts, tile), "list") if n > tile else posts.withColumn("block", F.xxhash64("list")).drop("list")
    return dealt.withColumn("bucket", F.pmod("block", F.lit(buckets))).groupBy("bucket").applyInArrow(run, "a long, b long")


def _alike(keys: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with this Jaccard similarity or more."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    keys, sets = keys[order], [sets[k] for k in order]
    size = np.array([len(s) for s in sets])
    met, pool = np.unique(np.concatenate(sets), return_inverse=True)
    start, label, mark, found = np.cumsum(size) - size, np.arange(len(sets)), np.zeros(len(met), bool), []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(size, size[i] / similarity + 1e-9, "right"))
        js = np.arange(i + 1, end)
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        mark[pool[start[i] : start[i] + size[i]]] = True
        step = max(1, 2_000_000 // int(size[js[-1]]))
        for at in range(0, len(js), step):
            some = js[at : at + step]
            both = np.add.reduceat(mark[gathered(pool, start[some], size[some])], np.cumsum(size[some]) - size[some], dtype=np.int64)
            for j in some[both >= similarity * (size[i] + size[some] - both) - 1e-9].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    found.append((int(keys[i]), int(keys[j])))
        mark[pool[start[i] : start[i] + size[i]]] = False
    return found


def verified(docs: DataFrame, groups: DataFrame, text_col: str, words: int, similarity: float, tile: int = 4096, tile_bytes: int = 8_000_000) -> DataFrame:
    """(a, b): links that connect exactly what all pairs of one group (sha, key, root) with this similarity connect."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    texts = docs.select(digest_of(text_col).alias("sha"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(counted(stored(groups)), "sha")
    texts = stored(texts.dropDuplicates(["key"]).drop("sha"))
    large = texts.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    large = large.select("root", F.ceil(F.greatest(F.col("n") / tile, F.col("bytes") / tile_bytes)).cast("int").alias("tiles")).filter("tiles > 1")
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(total / tile_bytes))

    def run(t: pa.Table) -> pa.Table:
        key, block = (t.column(c).to_numpy().astype(np.int64) for c in ("key", "block"))
        sets = [shingles(x, words) for x in as_bytes(t.column("text"))]
        order = np.argsort(block, kind="stable")
        edges = np.r_[0, np.flatnonzero(np.diff(block[order])) + 1, len(order)]
        found = [pair for lo, hi in zip(edges[:-1], edges[1:]) if hi - lo > 1 for pair in _alike(key[order[lo:hi]], [sets[k] for k in order[lo:hi]], similarity)]
        del sets
        release()
        return pa.Table.from_batches([batch_of(out, [a for a, _ in found], [b for _, b in found])], out)

    return tiled(texts, large, "root").withColumn("bucket", F.pmod("block", F.lit(buckets))).groupBy("bucket").applyInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that stay, in their own columns: one row of each class of near copies, that with the smallest id (null ids last)."""
    texts = signatures(docs, id_col, text_col, words)
    groups = connected_components(candidates(texts, texts.count())).withColumnRenamed("node", "key").join(texts.select("key", "sha"), "key")
    classes = stored(connected_components(verified(docs, groups, text_col, words, similarity)).withColumnRenamed("node", "key").join(texts.select("key", "sha", "id"), "key"))
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("f")).select("root", F.col("f.key").alias("first"))
    gone = classes.join(first, "root").filter("key <> first").select("sha", F.lit(True).alias("__gone"))
    marks = texts.filter("n > 1").select("sha", F.col("id").alias("__first"), F.lit(True).alias("__again"))
    marks = stored(marks.join(gone, "sha", "full").withColumnRenamed("sha", "__key"))
    rows = docs.select(F.struct("*").alias("__row"), digest_of(text_col).alias("__own"), F.col(id_col).alias("__id"))
    marked = rows.join(counted(marks), F.col("__own") == F.col("__key"), "left").filter("__gone is null")
    once = marked.filter("__again is null").select("__row")
    again = marked.filter("__again").filter(F.col("__id").eqNullSafe(F.col("__first"))).select("__row", "__key").dropDuplicates(["__key"])
    return once.union(again.select("__row")).select("__row.*")
