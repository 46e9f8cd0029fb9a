"""The paged feed as a stream: every micro-batch goes on where the last one ended.

The state is a keyed table of seen urls, of which a batch reads the buckets of its own urls, and marks in its record: rows read and new, the streak of
seen rows, and the page at which the feed stops. Urls and marks appear together, so a batch that comes again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.feed import flagged_new, pages
from rillflow.sources.keyed import KeyedTable
from rillflow.sources.store import kept

SEEN = T.StructType([T.StructField("url", T.StringType()), T.StructField("page_no", T.LongType())])


def seen_urls(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The state of a feed: url, and the page that brought it (null: known before)."""
    return KeyedTable(spark, path, SEEN, "url", buckets)


def feed_batch(feed: DataFrame, number: int, seen: KeyedTable, to: str, limit: int = 1000, quota: int | None = None) -> None:
    """Pages (page_no, pos, url) that follow those of all batches before. Writes page_no, n_read, n_new, streak, total_read, total_new and unique_total of
    each under the batch's number. The stop mark is the first page whose streak reaches the limit, or whose unique total reaches the quota."""
    held = seen.version()
    if held.marks.get("batch", -1) >= number:
        return
    before = {k: held.marks.get(k, 0) for k in ("total_read", "total_new", "streak")}
    touched = [r["b"] for r in feed.filter("url is not null").select(seen.bucket("url").alias("b")).distinct().collect()]  # at most `buckets`
    flagged = kept(flagged_new(feed, seen.read(held, touched)))
    per = pages(flagged, held.rows)
    # until the batch's first new row the streak of the batches before goes on
    per = per.withColumns({"streak": F.col("streak") + F.when(F.col("total_new") == 0, F.lit(before["streak"])).otherwise(0), "total_read": F.col("total_read") + before["total_read"], "total_new": F.col("total_new") + before["total_new"]})
    per.write.mode("overwrite").parquet(f"{to}/batch={number}")
    per = seen.spark.read.schema(per.schema).parquet(f"{to}/batch={number}")
    ends = F.col("streak") >= limit
    ends = ends if quota is None else ends | (F.col("unique_total") >= quota)
    last = per.agg(F.max_by(F.struct("streak", "total_read", "total_new"), "page_no").alias("l"), F.min(F.when(ends, F.col("page_no"))).alias("stop")).first()
    marks = {"batch": number} | ({} if last["l"] is None else last["l"].asDict())
    if "stop" not in held.marks and last["stop"] is not None:
        marks["stop"] = int(last["stop"])
    new = flagged.filter(F.col("is_new") & F.col("url").isNotNull()).groupBy("url").agg(F.min("page_no").alias("page_no"))
    seen.merge(new, ignore=True, marks=marks)


def run_feed(stream: DataFrame, seen: KeyedTable, to: str, checkpoint: str, limit: int = 1000, quota: int | None = None, after: Callable[[int], None] | None = None) -> None:
    """feed_batch over a stream whose batches come in the order of their pages; once the feed has stopped, later pages are only counted."""

    def batch(df: DataFrame, number: int) -> None:
        feed_batch(df, number, seen, to, limit, quota)
        if after is not None:
            after(number)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
