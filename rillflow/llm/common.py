"""Helpers shared by the corpus operators.

Exchanges of packed arrays: several operators move values that exist once for nearly every byte or word of
the corpus. Such values travel as binary arrays in rows ``(bucket, part, ...)``: a *part* is a bounded set of
documents, a *bucket* is a hash range of the values. Both counts follow the input, so no task's input grows
with the corpus.
"""

from __future__ import annotations

import gc
import math
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.sources.store import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a temporary one on a local master, an error elsewhere."""
    return shared_root(spark)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/rillflow-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Small sides of joins with texts are broadcast up to this many rows (some 100 bytes each); beyond it the texts are shuffled to them.
BROADCAST_ROWS = 200_000


def counted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if its rows, which are counted, are few. df: stored, or cheap to make twice."""
    return F.broadcast(df) if df.count() <= most else df


def release() -> None:
    """Gives memory that is free back to the system: a Python worker stays for later tasks, and what it has once held would stay with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(task):
    """A function over a task's batches that releases memory when the task has ended."""

    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, b"" for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list:
    return ["" if x is None else x for x in column.to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in a table; one scan of one column."""
    return int(docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0)


def part_edges(docs: DataFrame, id_col: str, n_bytes: int, part_bytes: int) -> list[int]:
    """Upper edges of contiguous id ranges that hold about part_bytes of text each (approximate quantiles of the ids, as in a range
    partitioner: one number a part). The edge of an id that fills several parts comes several times."""
    n = max(1, math.ceil(n_bytes / part_bytes))
    if n == 1:
        return []
    found = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], max(10_000, 50 * n))).first()[0]
    return sorted(found or [])


def part_of(id_col: str, text_col: str, edges: list[int], nulls: int) -> Column:
    """Number of the range that an id falls into: log2 comparisons a row. An id that fills several parts is dealt to them by a hash
    of the text, and so are null ids, to `nulls` parts more."""
    met, first, times = np.unique(np.array(edges, np.int64), return_index=True, return_counts=True)
    many = np.r_[times, 1]
    met, first, times = met.tolist(), [*first.tolist(), len(edges)], times.tolist()
    salt = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            if lo < len(met) and times[lo] > 1:
                return F.when(F.col(id_col) == F.lit(met[lo]), F.lit(first[lo]) + F.pmod(salt, F.lit(times[lo]))).otherwise(F.lit(first[lo]))
            return F.lit(first[lo])
        mid = (lo + hi) // 2
        return F.when(F.col(id_col) <= F.lit(met[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    n = len(edges) + 1
    if len(met) > 512:  # too many for one expression
        upper, lows = np.array(met), np.array(first)

        @F.pandas_udf("int")
        def found(x: pd.Series, s: pd.Series) -> pd.Series:
            ids = x.fillna(0).to_numpy()
            at = np.searchsorted(upper, ids)
            hot = (at < len(upper)) & (upper[np.minimum(at, len(upper) - 1)] == ids)
            return pd.Series((lows[at] + np.where(hot, s.to_numpy() % many[at], 0)).astype(np.int32))

        held = found(F.col(id_col).cast("long"), salt)
    else:
        held = tree(0, len(met))
    return F.when(F.col(id_col).isNull(), F.lit(n) + F.pmod(salt, F.lit(max(1, nulls)))).otherwise(held).cast("int")


#: Partitions of an exchange, at most; groups beyond that share partitions and are still worked on one by one.
MOST_PARTITIONS = 100_000


def dealt(df: DataFrame, groups: int, by: str) -> DataFrame:
    """Rows by a number below `groups`, each in a partition of its own as long as there are not too many."""
    return df.repartitionById(groups, by) if groups <= MOST_PARTITIONS else df.repartition(MOST_PARTITIONS, by)


def parted(docs: DataFrame, id_col: str, text_col: str, part: Column, parts: int) -> DataFrame:
    """Columns part (below `parts`), id, text, dealt by part: one shuffle of the text; equal plans reuse it."""
    return dealt(docs.select(part.alias("part"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), parts, "part")


def concat_binary(column: pa.Array, dtype) -> np.ndarray:
    """All values of a binary column as one numpy array."""
    got = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate(got) if got else np.empty(0, dtype)


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[starts[i] : starts[i] + sizes[i]] for all i, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def slices_of(column: pa.Array, most: int = 8_000_000):
    """(first, rows) slices of a string column with about `most` bytes each, nulls as empty texts."""
    column = pc.fill_null(column.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, column.slice(at, to - at)
        at = to


#: Bytes as they are, but A-Z in lower case; and the same with every other ASCII byte but 0-9 and a-z as a space.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WORDS = np.array([b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER.tolist()], np.uint8)


def translated(column: pa.Array, table: np.ndarray) -> pa.Array:
    """A string column without nulls, byte by byte through a table that leaves bytes of 128 and more alone."""
    column = pa.concat_arrays([column])  # drops the offset of a slice
    raw = column.buffers()[2]
    data = pa.py_buffer(table[np.frombuffer(raw, np.uint8)]) if raw is not None and raw.size else raw
    return pa.StringArray.from_buffers(len(column), column.buffers()[1], data, offset=column.offset)


def word_lists(column: pa.Array, table: np.ndarray = WORDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word among them, and each text's count of words. column: no nulls."""
    met, which, per_text = factorised(pc.ascii_split_whitespace(translated(column, table)))
    if "" in met:  # from white space at an end
        empty = met.index("")
        full = which != empty
        ends = np.cumsum(per_text)
        kept = np.r_[0, np.cumsum(full)]
        per_text = kept[ends] - kept[ends - per_text]
        met = met[:empty] + met[empty + 1 :]
        which = which[full]
        which = np.where(which > empty, which - 1, which)
    return met, which, per_text


@contextmanager
def no_cycles():
    """Without the search for reference cycles, which would walk the caches again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def factorised(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct strings, the number of each value among them, and each row's count of values."""
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable. edges: (a, b) long, any direction, repeats allowed.

    Alternating large-star and small-star rounds, each written to the shared folder; rounds grow with the
    logarithm of the number of nodes. Only counts and checksums reach the driver.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour moves to the least of the neighbourhood
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself move to the least smaller neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = stored(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        seen = now
