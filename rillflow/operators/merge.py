"""Keyed merges as set operations: conflicts are found before anything is written, so no row is retried."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_non_null(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row for each key: of every column the last value in `seq` order that is not null; and seq of the key's first row."""
    rest = [c for c in df.columns if c not in (key, seq)]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(seq), F.col(c).alias("v"))))["v"].alias(c) for c in rest]
    return df.groupBy(key).agg(*last, F.min(seq).alias(seq))


def key_conflicts(old: DataFrame, new: DataFrame, key: str, unique: str, seq: str) -> DataFrame:
    """Rows of `new` (one for each key) that may not be inserted: another key holds their unique value already, or an earlier new row
    takes it. Rows whose key exists never conflict: they update, and their unique value stays."""
    fresh = new.join(old.select(key), key, "left_anti")
    held = old.select(unique).filter(F.col(unique).isNotNull()).distinct().withColumn("__taken", F.lit(True))
    first = fresh.groupBy(unique).agg(F.min(seq).alias("__first")).join(held, unique, "left")
    return fresh.join(first, unique).filter(F.col("__taken") | (F.col(seq) > F.col("__first"))).select(*new.columns)


def upsert(old: DataFrame, new: DataFrame, key: str, fixed: tuple[str, ...] = ()) -> DataFrame:
    """old's columns plus `action` (inserted, updated, unchanged). new holds one row for each key.

    For keys in both, every column takes the new value unless that is null; `fixed` columns keep the old one. One shuffle of
    each side by key.
    """
    o, n = old.alias("o"), new.alias("n")
    value = lambda c: F.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in fixed else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    action = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "unchanged").otherwise("updated")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[value(c).alias(c) for c in old.columns], action.alias("action"))


def insert_ignore(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of `new` whose key is not stored; of equal keys the first in seq order. Null keys are left out."""
    fresh = new.filter(F.col(key).isNotNull()).join(old.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), seq).alias("__r")).select(*[F.col(c) if c == key else F.col(f"__r.{c}") for c in new.columns])


def newest_by_key(key: str, *ranked: DataFrame) -> DataFrame:
    """Union of tables in rising precedence: for each key the row of the highest table; null keys are left out."""
    tables = [t.withColumn("__rank", F.lit(k)) for k, t in enumerate(ranked)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).filter(F.col(key).isNotNull())
    rest = [c for c in every.columns if c not in (key, "__rank")]
    best = every.groupBy(key).agg(F.max_by(F.struct(*rest), "__rank").alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are not done yet; rows without a key always are processed."""
    return df.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def progress(df: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """One row: total, completed, remaining, failed."""
    marked = df.select(key).join(done.select(key).distinct().withColumn("__d", F.lit(True)), key, "left").join(failed.select(key).distinct().withColumn("__f", F.lit(True)), key, "left")
    return marked.agg(F.count("*").alias("total"), F.count_if("__d").alias("completed"), F.count_if(F.col("__d").isNull()).alias("remaining"), F.count_if(F.col("__f") & F.col("__d").isNull()).alias("failed"))


def key_union(key: str, *batches: DataFrame) -> DataFrame:
    """The distinct keys of all batches; null keys are left out."""
    return reduce(DataFrame.union, [b.select(key) for b in batches]).filter(F.col(key).isNotNull()).distinct()
