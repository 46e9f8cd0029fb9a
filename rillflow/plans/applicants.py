"""The questions over self-reported results: functions from a results table (and parameters) to a small answer table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.functions import numbers as N
from rillflow.functions import text as X

#: Fixed values of the preset questions.
TERM, PREVIOUS_TERM = "Fall 2026", "Fall 2025"
ACCEPTED = "Accepted%"
LISTED = ["Georgetown University", "Massachusetts Institute of Technology", "MIT", "Stanford University", "Carnegie Mellon University"]
JHU = ["%, Johns Hopkins University%", "%, JHU%"]
USC = ["University of Southern California", "USC"]
VALID_TERM = r"(Spring|Summer|Fall|Winter) \d{4}"
SCHOOL, SINCE, LONGEST = "University of Southern California", 2024, 100
LEAST_ROWS, DEFAULT_ROWS, MOST_ROWS = 1, 50, 100

#: A results table derived from the star schema's orders; the text runs on Spark SQL and DuckDB alike.
VIEW = """
select cast(o_orderkey as int) as p_id,
  concat(case o_orderkey%5 when 0 then 'Computer Science' when 1 then 'computer science'
                           when 2 then 'Physics' when 3 then 'Art' else 'Biology' end, ', ',
         case o_custkey%8 when 0 then 'Johns Hopkins University' when 1 then 'MIT'
                          when 2 then 'Stanford University' when 3 then 'University of Southern California'
                          when 4 then 'USC' when 5 then 'JHU'
                          when 6 then '100% Online University' else 'Georgetown University' end) as program,
  case when o_orderkey%7=0 then null else concat('note ', cast(o_orderkey as string)) end as comments,
  cast(o_orderdate as date) as date_added,
  concat('https://example.org/result/', cast(o_orderkey as string)) as url,
  case o_orderstatus when 'O' then 'Accepted on 10 Sep' when 'F' then 'Rejected on 11 Sep' else 'Wait listed' end as status,
  case when o_orderkey%97=0 then 'Fall' when o_orderkey%89=0 then 'Autumn 2026'
       else concat(case when month(o_orderdate)<=6 then 'Spring' else 'Fall' end, ' ',
                   cast(year(o_orderdate)+25 as string)) end as term,
  case o_custkey%3 when 0 then 'American' when 1 then 'International' else 'Other' end as us_or_international,
  case when o_orderkey%4=0 then null else cast(200 + o_orderkey%201 as double)/100.0e0 end as gpa,
  case when o_orderkey%5=0 then null else cast(130 + o_orderkey%41 as double) end as gre,
  case when o_orderkey%6=0 then null else cast(130 + o_custkey%41 as double) end as gre_v,
  case when o_orderkey%9=0 then null else cast(o_orderkey%13 as double)/2.0e0 end as gre_aw,
  case substr(o_orderpriority,1,1) when '1' then 'PhD' when '2' then 'Other' else 'Masters' end as degree,
  case o_orderkey%5 when 0 then 'Computer Science' when 1 then 'Computer Science'
                    when 2 then 'Physics' when 3 then 'Art' else 'Biology' end as llm_generated_program,
  case o_custkey%8 when 0 then 'Johns Hopkins University' when 1 then 'Massachusetts Institute of Technology'
                   when 2 then 'Stanford University' when 3 then 'University of Southern California'
                   when 4 then 'University of Southern California' when 5 then 'Johns Hopkins University'
                   when 6 then null else 'Georgetown University' end as llm_generated_university
from orders
"""


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(VIEW.replace("from orders", "from {orders}"), orders=orders)


class InvalidSchool(ValueError):
    """A search text that is too long or has characters that cannot be printed."""


def search_text(text: str | None) -> str:
    """Collapsed white space; the default for blank text."""
    out = re.sub(r"\s+", " ", text or "").strip() or SCHOOL
    if len(out) > LONGEST or not out.isprintable():
        raise InvalidSchool("at most 100 printable characters")
    return out


def row_limit(n: object = None) -> int:
    try:
        return min(MOST_ROWS, max(LEAST_ROWS, int(n)))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return DEFAULT_ROWS


def _accepted() -> Column:
    return F.col("status").ilike(ACCEPTED)


def _listed_phd(term: str) -> Column:
    return X.equals_ci("term", term) & X.equals_ci("degree", "PhD") & _accepted()


def _raw_listed() -> Column:
    return F.col("program").ilike("Computer Science, %") & X.ilike_any("program", [f"%, {n}" for n in LISTED])


def q1(df: DataFrame, term: str = TERM) -> DataFrame:
    """Entries of a term."""
    return df.filter(X.equals_ci("term", term)).agg(F.count("*").alias("cnt_fall26"))


def q2(df: DataFrame) -> DataFrame:
    """Share of international entries among those with an origin."""
    share = N.percent_where(X.equals_ci("us_or_international", "International"))
    return df.filter(X.is_given("us_or_international")).agg(N.percent_text(share).alias("pct_intl"))


def q3(df: DataFrame) -> DataFrame:
    """Averages of the four scores: one scan."""
    return df.agg(*[N.average2(F.col(c)).cast("decimal(20,2)").alias(f"avg_{c}") for c in ("gpa", "gre", "gre_v", "gre_aw")])


def q4(df: DataFrame, term: str = TERM) -> DataFrame:
    return df.filter(X.equals_ci("term", term) & X.equals_ci("us_or_international", "American") & F.col("gpa").isNotNull()).agg(N.average2(F.col("gpa")).cast("decimal(20,2)").alias("avg_gpa_us_fall26"))


def q5(df: DataFrame, term: str = PREVIOUS_TERM) -> DataFrame:
    """Share of acceptances among all entries of a term, those without a status included."""
    return df.filter(X.equals_ci("term", term)).agg(N.percent_where(_accepted()).cast("decimal(20,2)").alias("pct_accepted_fall25"))


def q6(df: DataFrame, term: str = TERM) -> DataFrame:
    return df.filter(X.equals_ci("term", term) & _accepted() & F.col("gpa").isNotNull()).agg(N.average2(F.col("gpa")).cast("decimal(20,2)").alias("avg_gpa_accepted_fall26"))


def q7(df: DataFrame) -> DataFrame:
    keep = X.equals_ci("degree", "Masters") & F.col("program").ilike("Computer Science, %") & X.ilike_any("program", JHU)
    return df.filter(keep).agg(F.count("*").alias("cnt_jhu_ms_cs"))


def q8(df: DataFrame, term: str = TERM) -> DataFrame:
    return df.filter(_listed_phd(term) & _raw_listed()).agg(F.count("*").alias("cnt_fall26_cs_phd"))


def q9(df: DataFrame, term: str = TERM) -> DataFrame:
    """Q8 on raw and on standardised names: one scan."""
    std = X.equals_ci("llm_generated_program", "Computer Science") & X.ilike_any("llm_generated_university", LISTED)
    both = df.filter(_listed_phd(term)).agg(F.count_if(_raw_listed()).alias("cnt_fall26_cs_phd_original"), F.count_if(std).alias("cnt_fall26_cs_phd_llm"))
    return both.withColumn("llm_less_original", F.col("cnt_fall26_cs_phd_llm") - F.col("cnt_fall26_cs_phd_original"))


def a1(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Share of all acceptances by valid term, in time order. The window is over the few terms."""
    counted = df.filter(_accepted() & X.matches_ci("term", VALID_TERM)).groupBy("term").agg(F.count("*").alias("cnt"))
    share = N.percent_of(F.col("cnt"), F.sum("cnt").over(W.partitionBy()))
    shared = counted.select("term", share.cast("decimal(20,2)").alias("pct_of_acceptances"))
    return shared.orderBy(X.trailing_year("term"), F.when(F.col("term").ilike("Spring%"), 0).otherwise(1), "term").limit(row_limit(limit))


def a2(df: DataFrame) -> DataFrame:
    """Average GPA of accepted and other entries at one school; rows without a status are neither."""
    at = df.filter(X.ilike_any("program", [f"%, {n}" for n in USC]))
    yes, no = (N.average2(F.when(c, F.col("gpa"))).cast("decimal(20,2)") for c in (_accepted(), ~_accepted()))
    both = at.agg(yes.alias("avg_gpa_accepted_usc"), no.alias("avg_gpa_not_accepted_usc"))
    return both.withColumn("gpa_diff", (F.col("avg_gpa_accepted_usc") - F.col("avg_gpa_not_accepted_usc")).cast("decimal(20,2)"))


def a3(df: DataFrame, school: str | None = None, since: int = SINCE, limit: int | None = None) -> DataFrame:
    """Accepted results of recent terms at schools whose name contains a text, newest first."""
    return a3_ranked(df, school, since, limit).orderBy("nth").drop("nth")


def a3_ranked(df: DataFrame, school: str | None = None, since: int = SINCE, limit: int | None = None) -> DataFrame:
    """a3's rows with their place, nth. The window is over at most a hundred rows."""
    keep = _accepted() & (X.trailing_year("term") >= since) & X.contains_ci(X.last_segment("program"), search_text(school))
    found = df.filter(keep).orderBy(F.desc("date_added"), F.desc("p_id")).limit(row_limit(limit))
    nth = F.row_number().over(W.orderBy(F.desc("date_added"), F.desc("p_id"))).alias("nth")
    return found.select("program", "degree", "term", "status", "gpa", nth)


QUESTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {"Q1": q1, "Q2": q2, "Q3": q3, "Q4": q4, "Q5": q5, "Q6": q6, "Q7": q7, "Q8": q8, "Q9": q9, "A1": a1, "A2": a2, "A3": a3_ranked}
ORM_SUBSET = ["Q1", "Q2", "Q3", "Q4", "Q5", "Q6"]
PAGE_SUBSET = [q for q in QUESTIONS if q != "A3"]
NONE_FOUND = "No accepted results found."


def answer(name: str, rows: DataFrame) -> DataFrame:
    """One row: the answer's text."""
    c, n = F.col, N.text2
    lines: dict[str, Callable[[], Column]] = {
        "Q1": lambda: F.concat(F.lit("Applicant count: "), c("cnt_fall26").cast("string")),
        "Q2": lambda: F.concat(F.lit("Percent international: "), F.coalesce(c("pct_intl"), F.lit("N/A"))),
        "Q3": lambda: F.concat_ws(", ", *[F.concat(F.lit(f"Average {label}: "), n(c(f"avg_{k}"))) for k, label in (("gpa", "GPA"), ("gre", "GRE"), ("gre_v", "GRE V"), ("gre_aw", "GRE AW"))]),
        "Q4": lambda: F.concat(F.lit("Average GPA American: "), n(c("avg_gpa_us_fall26"))),
        "Q5": lambda: F.concat(F.lit("Acceptance percent: "), N.percent_text(c("pct_accepted_fall25"))),
        "Q6": lambda: F.concat(F.lit("Average GPA acceptance: "), n(c("avg_gpa_accepted_fall26"))),
        "Q7": lambda: F.concat(F.lit("Count: "), c("cnt_jhu_ms_cs").cast("string")),
        "Q8": lambda: F.concat(F.lit("Count: "), c("cnt_fall26_cs_phd").cast("string")),
        "Q9": lambda: F.concat(F.lit("Listed schools: "), c("cnt_fall26_cs_phd_original").cast("string"), F.lit(", standardised: "), c("cnt_fall26_cs_phd_llm").cast("string"), F.lit(", difference: "), N.signed(c("llm_less_original"))),
        "A2": lambda: F.concat(F.lit("Average GPA accepted: "), n(c("avg_gpa_accepted_usc")), F.lit(", not accepted: "), n(c("avg_gpa_not_accepted_usc")), F.lit(", difference: "), n(c("gpa_diff"))),
    }
    if name == "A1":
        season = F.when(c("term").ilike("Spring%"), 0).otherwise(1)
        line = F.concat(c("term"), F.lit(" acceptance: "), N.percent_text(c("pct_of_acceptances")))
        listed = F.array_sort(F.collect_list(F.struct(X.trailing_year("term").alias("y"), season.alias("s"), c("term"), line.alias("line"))))
        return rows.agg(F.coalesce(X.null_if_empty(F.array_join(listed["line"], ", ")), F.lit(NONE_FOUND)).alias("answer"))
    if name == "A3":
        line = F.concat_ws(" | ", "program", "degree", "term", "status", F.concat(F.lit("GPA: "), F.coalesce(c("gpa").cast("string"), F.lit("N/A"))))
        listed = F.array_sort(F.collect_list(F.struct("nth", line.alias("line"))))  # at most 100 rows
        return rows.agg(F.coalesce(X.null_if_empty(F.array_join(listed["line"], "\n")), F.lit(NONE_FOUND)).alias("answer"))
    return rows.select(lines[name]().alias("answer"))


def report(df: DataFrame, names: list[str] | None = None, questions: dict[str, Callable[[DataFrame], DataFrame]] | None = None, isolated: bool = True) -> DataFrame:
    """(question, answer, error) in order. Isolated, a question that fails reports its error and the rest go on."""
    spark, questions, out = df.sparkSession, questions or QUESTIONS, None
    for k, name in enumerate(names or list(questions)):
        try:
            rows = answer(name, questions[name](df)).select(F.lit(k).alias("nth"), F.lit(name).alias("question"), "answer", F.lit(None).cast("string").alias("error"))
            if isolated:
                rows = spark.createDataFrame(rows.collect(), rows.schema)  # one row; runs here so that its error stays here
        except Exception as e:  # noqa: BLE001
            if not isolated:
                raise
            rows = spark.createDataFrame([(k, name, None, f"{type(e).__name__}: {e}".splitlines()[0])], "nth int, question string, answer string, error string")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("nth").drop("nth")
