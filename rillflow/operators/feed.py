"""Bookkeeping of a paged feed (page_no, pos, url): what is new, when to stop, running totals.

Nothing here sorts all rows in one task: rows are reduced to pages, and sums over pages run in chunks of pages, with one row for
each chunk above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1000


def running(df: DataFrame, order: str, sums: dict[str, Column], maxima: dict[str, Column] | None = None, chunk: int = CHUNK) -> DataFrame:
    """df plus running sums and maxima over `order` (unique, integer), in two levels."""
    maxima = maxima or {}
    df = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    inside = W.partitionBy("__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    totals = df.groupBy("__chunk").agg(*[F.sum(v).alias(f"__s_{k}") for k, v in sums.items()], *[F.max(v).alias(f"__m_{k}") for k, v in maxima.items()])
    before = W.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("__chunk", *[F.sum(f"__s_{k}").over(before).alias(f"__s_{k}") for k in sums], *[F.max(f"__m_{k}").over(before).alias(f"__m_{k}") for k in maxima])
    local = df.withColumns({f"__l_{k}": F.sum(v).over(inside) for k, v in sums.items()} | {f"__x_{k}": F.max(v).over(inside) for k, v in maxima.items()})
    both = local.join(totals, "__chunk")
    out = {k: F.coalesce(F.col(f"__s_{k}"), F.lit(0)) + F.col(f"__l_{k}") for k in sums}
    out |= {k: F.greatest(F.col(f"__m_{k}"), F.col(f"__x_{k}")) if k in maxima else None for k in maxima}
    return both.withColumns(out).drop("__chunk", *[f"__{p}_{k}" for k in sums for p in "sl"], *[f"__{p}_{k}" for k in maxima for p in "mx"])


def flagged_new(feed: DataFrame, stored: DataFrame) -> DataFrame:
    """feed plus is_new: the url is not stored and no earlier page has it. Copies within a page are both new, rows without a url always are."""
    without = feed.filter("url is null").withColumn("is_new", F.lit(True))
    first = feed.filter("url is not null").groupBy("url").agg(F.min("page_no").alias("__first"))
    known = stored.filter("url <> ''").select("url").distinct().withColumn("__stored", F.lit(True))
    with_url = feed.filter("url is not null").join(first.join(known, "url", "left"), "url")
    with_url = with_url.withColumn("is_new", F.col("__stored").isNull() & (F.col("page_no") == F.col("__first")))
    return with_url.select(*feed.columns, "is_new").unionByName(without)


def pages(flagged: DataFrame, stored_count: int = 0) -> DataFrame:
    """One row for each page: n_read, n_new, streak (seen rows in a row at its end), and running total_read, total_new, unique_total."""
    last_new = F.max(F.when(F.col("is_new"), F.col("pos")))
    one = flagged.groupBy("page_no").agg(
        F.count("*").alias("n_read"),
        F.count_if("is_new").alias("n_new"),
        F.max("pos").alias("__last"),
        last_new.alias("__last_new"),
        F.countDistinct(F.when(F.col("is_new"), F.col("url"))).alias("n_urls"),
    )
    after = flagged.join(one.select("page_no", "__last_new"), "page_no").filter(F.col("__last_new").isNotNull() & (F.col("pos") > F.col("__last_new"))).groupBy("page_no").agg(F.count("*").alias("__tail"))
    one = one.join(after, "page_no", "left").withColumn("__tail", F.coalesce("__tail", F.lit(0)))
    summed = running(one, "page_no", {"total_read": F.col("n_read"), "total_new": F.col("n_new"), "__urls": F.col("n_urls")})
    # A page that is seen throughout goes on with the streak of the page before it.
    broken = F.when(F.col("n_new") > 0, F.struct("page_no", F.col("total_read"), F.col("__tail")))
    summed = running(summed, "page_no", {}, {"__since": broken})
    streak = F.when(F.col("__since").isNull(), F.col("total_read")).otherwise(F.col("total_read") - F.col("__since.total_read") + F.col("__since.__tail"))
    return summed.select("page_no", "n_read", "n_new", streak.alias("streak"), "total_read", "total_new", (F.col("__urls") + stored_count).alias("unique_total"))


def until_streak(flagged: DataFrame, per_page: DataFrame, limit: int = 1000) -> DataFrame:
    """Rows up to the first page whose streak reaches the limit at its end."""
    cut = per_page.filter(F.col("streak") >= limit).agg(F.min("page_no").alias("__cut"))
    return flagged.join(F.broadcast(cut), F.col("__cut").isNull() | (F.col("page_no") <= F.col("__cut"))).drop("__cut")  # one row


def until_quota(flagged: DataFrame, per_page: DataFrame, quota: int) -> DataFrame:
    """Rows up to the first page where the unique total (stored rows count) reaches the quota."""
    cut = per_page.filter(F.col("unique_total") >= quota).agg(F.min("page_no").alias("__cut"))
    return flagged.join(F.broadcast(cut), F.col("__cut").isNull() | (F.col("page_no") <= F.col("__cut"))).drop("__cut")  # one row
