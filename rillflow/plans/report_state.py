"""The report's state: partial sums of every question by bucket, and answers made of them.

A merge writes the buckets that it touches into a new folder (see sources.keyed). The state of a folder, one row of sums for each bucket, counts by
term, and the newest rows that the search may show, is made once, from that folder alone, and never changes; a report adds up the states of the buckets
that a version names. So after a merge only the rewritten buckets are scanned, however large the table is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions import numbers as N
from rillflow.functions import text as X
from rillflow.plans import applicants as A
from rillflow.sources.keyed import ROWS, KeyedTable
from rillflow.sources.store import exists

SCORES = ("gpa", "gre", "gre_v", "gre_aw")
SHOWN = ["date_added", "p_id", "program", "degree", "term", "status", "gpa"]


def partials() -> dict[str, Column]:
    """A name and an aggregate for each number that the answers are made of; all of them add up."""
    accepted = F.col("status").ilike(A.ACCEPTED)
    now, before = X.equals_ci("term", A.TERM), X.equals_ci("term", A.PREVIOUS_TERM)
    raw = F.col("program").ilike("Computer Science, %") & X.ilike_any("program", [f"%, {n}" for n in A.LISTED])
    standard = X.equals_ci("llm_generated_program", "Computer Science") & X.ilike_any("llm_generated_university", A.LISTED)
    phd = now & X.equals_ci("degree", "PhD") & accepted
    usc = X.ilike_any("program", [f"%, {n}" for n in A.USC])
    counts = {
        "n1": now,
        "given": X.is_given("us_or_international"),
        "foreign": X.is_given("us_or_international") & X.equals_ci("us_or_international", "International"),
        "n5": before,
        "accepted5": before & accepted,
        "n7": X.equals_ci("degree", "Masters") & F.col("program").ilike("Computer Science, %") & X.ilike_any("program", A.JHU),
        "n8": phd & raw,
        "n9": phd & standard,
    }
    means = {c: F.col(c) for c in SCORES}
    means |= {"q4": F.when(now & X.equals_ci("us_or_international", "American"), F.col("gpa")), "q6": F.when(now & accepted, F.col("gpa"))}
    means |= {"yes": F.when(usc & accepted, F.col("gpa")), "no": F.when(usc & ~accepted, F.col("gpa"))}
    return {k: F.count_if(c) for k, c in counts.items()} | {f"sum_{k}": F.sum(c) for k, c in means.items()} | {f"count_{k}": F.count(c) for k, c in means.items()}


def _made(table: KeyedTable, folder: str) -> None:
    """The state of a folder, if it is not there yet."""
    spark, to = table.spark, f"{table.path}/state/{folder}"
    if exists(spark, f"{to}/newest"):  # written last
        return
    rows = spark.read.schema(T.StructType([*table.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{table.path}/data/{folder}")
    rows.groupBy("bucket").agg(*[c.alias(k) for k, c in partials().items()]).coalesce(1).write.mode("overwrite").parquet(f"{to}/sums")
    accepted = rows.filter(F.col("status").ilike(A.ACCEPTED))
    accepted.filter(X.matches_ci("term", A.VALID_TERM)).groupBy("bucket", "term").agg(F.count("*").alias("cnt")).coalesce(1).write.mode("overwrite").parquet(f"{to}/terms")
    first = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("date_added"), F.desc("p_id")))
    found = accepted.filter((X.trailing_year("term") >= A.SINCE) & X.contains_ci(X.last_segment("program"), A.SCHOOL))
    found.withColumn("nth", first).filter(F.col("nth") <= A.MOST_ROWS).select("bucket", *SHOWN).coalesce(1).write.mode("overwrite").parquet(f"{to}/newest")


def frames(table: KeyedTable) -> dict[str, DataFrame]:
    """The answer rows of all questions over the table's version: the same columns that the questions give over the rows."""
    spark, named = table.spark, table.version().folders.get(ROWS, {})
    for folder in sorted(set(named.values())):
        _made(table, folder)
    live = F.broadcast(spark.createDataFrame(list(named.items()), "bucket int, folder string"))  # at most `buckets` rows

    def state(kind: str, schema: str) -> DataFrame:
        """The state's rows of the buckets that the version names."""
        if not named:
            return spark.createDataFrame([], schema)
        each = [spark.read.schema(schema).parquet(f"{table.path}/state/{f}/{kind}").withColumn("folder", F.lit(f)) for f in sorted(set(named.values()))]
        return reduce(DataFrame.unionByName, each).join(live, ["bucket", "folder"], "left_semi").drop("folder")

    names = partials()
    sums = state("sums", "bucket int, " + ", ".join(f"{k} {'double' if k.startswith('sum_') else 'long'}" for k in names))
    one = sums.agg(*[(F.sum(k) if k.startswith("sum_") else F.coalesce(F.sum(k), F.lit(0))).alias(k) for k in names])
    mean = lambda k: N.round2(F.try_divide(F.col(f"sum_{k}"), F.col(f"count_{k}"))).cast("decimal(20,2)")
    share = N.percent_of(F.col("cnt"), F.sum("cnt").over(W.partitionBy()))
    terms = state("terms", "bucket int, term string, cnt long").groupBy("term").agg(F.sum("cnt").alias("cnt"))
    newest = state("newest", "bucket int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields if f.name in SHOWN))
    newest = newest.orderBy(F.desc("date_added"), F.desc("p_id")).limit(A.DEFAULT_ROWS)
    nth = F.row_number().over(W.orderBy(F.desc("date_added"), F.desc("p_id"))).alias("nth")  # of at most a hundred rows
    return {
        "Q1": one.select(F.col("n1").alias("cnt_fall26")),
        "Q2": one.select(N.percent_text(N.percent_of(F.col("foreign"), F.col("given"))).alias("pct_intl")),
        "Q3": one.select(*[mean(c).alias(f"avg_{c}") for c in SCORES]),
        "Q4": one.select(mean("q4").alias("avg_gpa_us_fall26")),
        "Q5": one.select(N.percent_of(F.col("accepted5"), F.col("n5")).cast("decimal(20,2)").alias("pct_accepted_fall25")),
        "Q6": one.select(mean("q6").alias("avg_gpa_accepted_fall26")),
        "Q7": one.select(F.col("n7").alias("cnt_jhu_ms_cs")),
        "Q8": one.select(F.col("n8").alias("cnt_fall26_cs_phd")),
        "Q9": one.select(F.col("n8").alias("cnt_fall26_cs_phd_original"), F.col("n9").alias("cnt_fall26_cs_phd_llm"), (F.col("n9") - F.col("n8")).alias("llm_less_original")),
        "A1": terms.select("term", share.cast("decimal(20,2)").alias("pct_of_acceptances")).orderBy(X.trailing_year("term"), F.when(F.col("term").ilike("Spring%"), 0).otherwise(1), "term").limit(A.DEFAULT_ROWS),
        "A2": one.select(mean("yes").alias("avg_gpa_accepted_usc"), mean("no").alias("avg_gpa_not_accepted_usc"), (mean("yes") - mean("no")).cast("decimal(20,2)").alias("gpa_diff")),
        "A3": newest.select("program", "degree", "term", "status", "gpa", nth),
    }


def report(table: KeyedTable, names: list[str] | None = None) -> DataFrame:
    """(question, answer, error): the table's report from its state."""
    made = frames(table)
    return A.report(made["Q1"], names, {k: (lambda _, rows=rows: rows) for k, rows in made.items()}, isolated=False)


def recomputing(table: KeyedTable, to: str):
    """A message handler that makes the report and writes it under the message's step."""

    def handle(payload: dict, marks: dict) -> None:
        report(table).coalesce(1).write.mode("overwrite").parquet(f"{to}/step={marks['step']}")

    return handle
