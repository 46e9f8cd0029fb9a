"""Contains-searches by an index of trigrams: only buckets that can hold the text are read.

Every data folder of a keyed table (see sources.keyed) gets an index once: for each run of three characters in the small letters of a column's last
segment, the buckets that hold it, in the order of the runs, so that a search reads few row groups of it. A text of three characters or more can only stand
in buckets that hold all its trigrams; these are read, and the rows filtered exactly. Shorter texts are searched by a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions import text as X
from rillflow.plans import applicants as A
from rillflow.sources.keyed import ROWS, KeyedTable
from rillflow.sources.store import exists

GRAM = 3


def grams(text: str) -> list[str]:
    """The distinct trigrams of a text's small letters."""
    t = text.lower()
    return sorted({t[k : k + GRAM] for k in range(len(t) - GRAM + 1)})


def _index(table: KeyedTable, folder: str, column: str) -> DataFrame:
    """(gram, buckets) of a folder, made if it is not there yet."""
    spark, to = table.spark, f"{table.path}/grams/{column}/{folder}"
    if exists(spark, to):
        return spark.read.schema("gram string, buckets array<int>").parquet(to)
    rows = spark.read.schema(T.StructType([table.schema[column], T.StructField("bucket", T.IntegerType())])).parquet(f"{table.path}/data/{folder}")
    names = rows.select("bucket", F.lower(X.last_segment(column)).alias("name")).filter(F.length("name") >= GRAM).distinct()
    every = names.select("bucket", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))).alias("gram")).distinct()
    every.groupBy("gram").agg(F.array_sort(F.collect_list("bucket")).alias("buckets")).sortWithinPartitions("gram").write.mode("overwrite").parquet(to)  # a list holds at most all buckets
    return spark.read.schema("gram string, buckets array<int>").parquet(to)


def candidates(table: KeyedTable, text: str, column: str = "program") -> list[int]:
    """Buckets of the newest version whose last segments may contain the text, letter case apart."""
    named, wanted = table.version().folders.get(ROWS, {}), grams(text)
    if not wanted:
        return sorted(named)
    found: list[int] = []
    for folder in sorted(set(named.values())):
        met = _index(table, folder, column).filter(F.col("gram").isin(wanted)).select(F.explode("buckets").alias("bucket"))
        whole = met.groupBy("bucket").count().filter(F.col("count") == len(wanted)).collect()  # at most all buckets
        found += [r["bucket"] for r in whole if named.get(r["bucket"]) == folder]
    return sorted(found)


def a3_indexed(table: KeyedTable, school: str | None = None, since: int = A.SINCE, limit: int | None = None) -> DataFrame:
    """The school search over a keyed table: A3's rows, read from candidate buckets only."""
    text = A.search_text(school)
    return A.a3(table.read(buckets=candidates(table, text)), text, since, limit)
