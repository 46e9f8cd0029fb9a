"""Incremental loads by a high-water mark for each source.

A mark only rises: an explicit lower `since` reads older rows again (the insert ignores those that are stored) but never moves the
mark back. Ids at or below the mark that arrive late are skipped, unless `since` asks for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators.merge import insert_ignore, upsert


def mark_of(marks: DataFrame, source: str) -> int:
    """The stored mark, -1 where there is none. One row of the state table."""
    found = marks.filter(F.col("source") == source).select(F.col("last_seen").cast("long")).first()
    return -1 if found is None or found[0] is None else int(found[0])


def raised(marks: DataFrame, source: str, candidates: DataFrame, key: str) -> DataFrame:
    """The state table after a load: the source's mark is the greatest of its own and the candidates' ids."""
    top = candidates.agg(F.max(key).alias("m")).filter("m is not null").select(F.lit(source).alias("source"), F.col("m").cast("string").alias("last_seen"), F.current_timestamp().alias("updated_at"))
    old = marks.select("source", F.col("last_seen").alias("before"))
    top = top.join(F.broadcast(old), "source", "left").select("source", F.greatest(F.col("last_seen").cast("long"), F.col("before").cast("long")).cast("string").alias("last_seen"), "updated_at")
    return upsert(marks, top, "source").drop("action")


def incremental(stored: DataFrame, feed: DataFrame, marks: DataFrame, source: str, key: str, seq: str, since: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, new state table). Write the rows before the state, and a repeated load changes nothing."""
    threshold = mark_of(marks, source) if since is None else since
    candidates = feed.filter(F.col(key) > threshold)
    return insert_ignore(stored, candidates, key, seq), raised(marks, source, candidates, key)
