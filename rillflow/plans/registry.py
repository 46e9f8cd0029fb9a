"""All registered queries (spark, sf_dir) -> DataFrame, and for each the SQL that gives the same rows on DuckDB."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import numbers as N
from rillflow.functions import text as X
from rillflow.operators import feed as C
from rillflow.operators import html_rows as H
from rillflow.operators import merge as U
from rillflow.operators import names as M
from rillflow.operators import validate as V
from rillflow.operators import watermark as K
from rillflow.plans import applicants as A
from rillflow.plans.load import load_results, results_table
from rillflow.plans.report_state import recomputing
from rillflow.plans.search import a3_indexed as school_search
from rillflow.schemas import MARKS, RAW
from rillflow.sources import results as S
from rillflow.sources.keyed import KeyedTable, Violates
from rillflow.sources.store import Shrinks, current, publish, shared_folder
from rillflow.sources.tasks import message, message_stream, write_messages
from rillflow.streaming import tasks as T
from rillflow.streaming.feed import run_feed, seen_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WITH_APPLICANTS = f"WITH applicants AS ({A.VIEW}) "


def query(sql: str | None = None, applicants: bool = False):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (WITH_APPLICANTS if applicants else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """SQL over tables that it names as {table}."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


# ---- questions -----------------------------------------------------------------------------------------------------------

LISTED_SQL = " OR ".join(f"program ILIKE '%, {n}'" for n in A.LISTED)
LISTED_STD_SQL = " OR ".join(f"llm_generated_university ILIKE '{n}'" for n in A.LISTED)
PHD_SQL = "term ILIKE 'Fall 2026' AND degree ILIKE 'PhD' AND status ILIKE 'Accepted%'"
AVG2 = "CAST(round(CAST(avg({c}) AS DECIMAL(38,10)), 2) AS DECIMAL(20,2))".format
PCT = "CAST(round(CAST(count(*) FILTER ({c}) AS DECIMAL(20,0)) * 100 / nullif(count(*), 0), 2) AS DECIMAL(20,2))".format


@query("SELECT count(*) AS cnt_fall26 FROM applicants WHERE term ILIKE 'Fall 2026'", True)
def q1_count_ci(spark, sf_dir):
    return A.q1(A.applicants(spark, sf_dir))


@query(f"SELECT concat(CAST({PCT(c="us_or_international ILIKE 'International'")} AS VARCHAR), '%') AS pct_intl FROM applicants WHERE us_or_international <> ''", True)
def q2_percent_of_given(spark, sf_dir):
    return A.q2(A.applicants(spark, sf_dir))


@query("SELECT " + ", ".join(f"{AVG2(c=c)} AS avg_{c}" for c in ("gpa", "gre", "gre_v", "gre_aw")) + " FROM applicants", True)
def q3_averages(spark, sf_dir):
    return A.q3(A.applicants(spark, sf_dir))


@query(f"SELECT {AVG2(c='gpa')} AS avg_gpa_us_fall26 FROM applicants WHERE term ILIKE 'Fall 2026' AND us_or_international ILIKE 'American'", True)
def q4_average_filtered(spark, sf_dir):
    return A.q4(A.applicants(spark, sf_dir))


@query(f"SELECT {PCT(c="status ILIKE 'Accepted%'")} AS pct_accepted_fall25 FROM applicants WHERE term ILIKE 'Fall 2025'", True)
def q5_percent_accepted(spark, sf_dir):
    return A.q5(A.applicants(spark, sf_dir))


@query(f"SELECT {AVG2(c='gpa')} AS avg_gpa_accepted_fall26 FROM applicants WHERE term ILIKE 'Fall 2026' AND status ILIKE 'Accepted%'", True)
def q6_average_accepted(spark, sf_dir):
    return A.q6(A.applicants(spark, sf_dir))


@query("SELECT count(*) AS cnt_jhu_ms_cs FROM applicants WHERE degree ILIKE 'Masters' AND program ILIKE 'Computer Science, %' AND (program ILIKE '%, Johns Hopkins University%' OR program ILIKE '%, JHU%')", True)
def q7_ilike_any(spark, sf_dir):
    return A.q7(A.applicants(spark, sf_dir))


@query(f"SELECT count(*) AS cnt_fall26_cs_phd FROM applicants WHERE {PHD_SQL} AND program ILIKE 'Computer Science, %' AND ({LISTED_SQL})", True)
def q8_listed_schools(spark, sf_dir):
    return A.q8(A.applicants(spark, sf_dir))


@query(
    f"""SELECT count(*) FILTER (program ILIKE 'Computer Science, %' AND ({LISTED_SQL})) AS cnt_fall26_cs_phd_original,
  count(*) FILTER (llm_generated_program ILIKE 'Computer Science' AND ({LISTED_STD_SQL})) AS cnt_fall26_cs_phd_llm,
  count(*) FILTER (llm_generated_program ILIKE 'Computer Science' AND ({LISTED_STD_SQL})) - count(*) FILTER (program ILIKE 'Computer Science, %' AND ({LISTED_SQL})) AS llm_less_original
FROM applicants WHERE {PHD_SQL}""",
    True,
)
def q9_raw_vs_std(spark, sf_dir):
    return A.q9(A.applicants(spark, sf_dir))


A1_SQL = r"""SELECT term, CAST(round(CAST(count(*) AS DECIMAL(20,0)) * 100 / sum(count(*)) OVER (), 2) AS DECIMAL(20,2)) AS pct_of_acceptances FROM applicants
WHERE status ILIKE 'Accepted%' AND regexp_matches(term, '^(Spring|Summer|Fall|Winter) \d{4}$', 'i') GROUP BY term"""


@query(A1_SQL, True)
def a1_term_share(spark, sf_dir):
    return A.a1(A.applicants(spark, sf_dir))


@query(
    f"""SELECT *, CAST(avg_gpa_accepted_usc - avg_gpa_not_accepted_usc AS DECIMAL(20,2)) AS gpa_diff FROM (
  SELECT {AVG2(c="CASE WHEN status ILIKE 'Accepted%' THEN gpa END")} AS avg_gpa_accepted_usc, {AVG2(c="CASE WHEN status NOT ILIKE 'Accepted%' THEN gpa END")} AS avg_gpa_not_accepted_usc
  FROM applicants WHERE program ILIKE '%, University of Southern California' OR program ILIKE '%, USC')""",
    True,
)
def a2_group_diff(spark, sf_dir):
    return A.a2(A.applicants(spark, sf_dir))


A3_SQL = r"""SELECT program, degree, term, status, gpa FROM applicants
WHERE status ILIKE 'Accepted%' AND TRY_CAST(nullif(regexp_extract(term, '(\d{4})$', 1), '') AS INT) >= 2024
  AND regexp_replace(program, '^.*, ', '') ILIKE '%University of Southern California%' ORDER BY date_added DESC, p_id DESC LIMIT 50"""


@query(A3_SQL, True)
def a3_school_search(spark, sf_dir):
    return A.a3(A.applicants(spark, sf_dir))


@query(A3_SQL.replace("University of Southern California", r"100\%").replace("%100\\%%'", r"%100\%%' ESCAPE '\'"), True)
def a3_search_wildcards(spark, sf_dir):
    """A wildcard in the search text is taken literally."""
    return A.a3(A.applicants(spark, sf_dir), school="100%")


ANSWERS_SQL = f"""
SELECT 'Q1' AS question, concat('Applicant count: ', count(*)) AS answer, CAST(NULL AS VARCHAR) AS error FROM applicants WHERE term ILIKE 'Fall 2026'
UNION ALL SELECT 'Q5', coalesce(concat('Acceptance percent: ', CAST({PCT(c="status ILIKE 'Accepted%'")} AS VARCHAR), '%'), 'Acceptance percent: N/A'), NULL FROM applicants WHERE term ILIKE 'Fall 2025'
UNION ALL SELECT 'Q9', concat('Listed schools: ', o, ', standardised: ', l, ', difference: ', CASE WHEN l >= o THEN '+' ELSE '' END, l - o), NULL FROM (
  SELECT count(*) FILTER (program ILIKE 'Computer Science, %' AND ({LISTED_SQL})) AS o, count(*) FILTER (llm_generated_program ILIKE 'Computer Science' AND ({LISTED_STD_SQL})) AS l FROM applicants WHERE {PHD_SQL})
UNION ALL SELECT 'A1', string_agg(concat(term, ' acceptance: ', CAST(pct_of_acceptances AS VARCHAR), '%'), ', ' ORDER BY right(term, 4), CASE WHEN term ILIKE 'Spring%' THEN 0 ELSE 1 END, term), NULL FROM ({A1_SQL})
UNION ALL SELECT 'A2', concat('Average GPA accepted: ', a, ', not accepted: ', b, ', difference: ', CAST(a - b AS DECIMAL(20,2))), NULL FROM (
  SELECT {AVG2(c="CASE WHEN status ILIKE 'Accepted%' THEN gpa END")} AS a, {AVG2(c="CASE WHEN status NOT ILIKE 'Accepted%' THEN gpa END")} AS b FROM applicants WHERE program ILIKE '%, University of Southern California' OR program ILIKE '%, USC')
"""


@query(ANSWERS_SQL, True)
def report_all(spark, sf_dir):
    """Answer texts of five questions; report() gives all twelve in tests."""
    return A.report(A.applicants(spark, sf_dir), ["Q1", "Q5", "Q9", "A1", "A2"])


def _text(sql: str) -> str:
    return f"coalesce(CAST({sql} AS VARCHAR), 'N/A')"


SHARE = lambda c: f"coalesce(concat(CAST({PCT(c=c)} AS VARCHAR), '%'), 'N/A')"
OTHER_ANSWERS_SQL = f"""
UNION ALL SELECT 'Q2', concat('Percent international: ', {SHARE("us_or_international ILIKE 'International'")}), NULL FROM applicants WHERE us_or_international <> ''
UNION ALL SELECT 'Q3', concat('Average GPA: ', {_text(AVG2(c='gpa'))}, ', Average GRE: ', {_text(AVG2(c='gre'))}, ', Average GRE V: ', {_text(AVG2(c='gre_v'))}, ', Average GRE AW: ', {_text(AVG2(c='gre_aw'))}), NULL FROM applicants
UNION ALL SELECT 'Q4', concat('Average GPA American: ', {_text(AVG2(c='gpa'))}), NULL FROM applicants WHERE term ILIKE 'Fall 2026' AND us_or_international ILIKE 'American'
UNION ALL SELECT 'Q6', concat('Average GPA acceptance: ', {_text(AVG2(c='gpa'))}), NULL FROM applicants WHERE term ILIKE 'Fall 2026' AND status ILIKE 'Accepted%'
UNION ALL SELECT 'Q7', concat('Count: ', count(*)), NULL FROM applicants WHERE degree ILIKE 'Masters' AND program ILIKE 'Computer Science, %' AND (program ILIKE '%, Johns Hopkins University%' OR program ILIKE '%, JHU%')
UNION ALL SELECT 'Q8', concat('Count: ', count(*)), NULL FROM applicants WHERE {PHD_SQL} AND program ILIKE 'Computer Science, %' AND ({LISTED_SQL})"""
A3_LINES_SQL = f"""
UNION ALL SELECT 'A3', coalesce(string_agg(concat_ws(' | ', program, degree, term, status, concat('GPA: ', coalesce(CAST(gpa AS VARCHAR), 'N/A'))), chr(10) ORDER BY date_added DESC, p_id DESC), 'No accepted results found.'), NULL
FROM ({A3_SQL.replace("program, degree, term, status, gpa FROM", "program, degree, term, status, gpa, date_added, p_id FROM")})"""


@query(ANSWERS_SQL + OTHER_ANSWERS_SQL + A3_LINES_SQL, True)
def report_twelve(spark, sf_dir):
    """All twelve answers, each question isolated from the others' errors."""
    return A.report(A.applicants(spark, sf_dir))


@query(ANSWERS_SQL + OTHER_ANSWERS_SQL, True)
def report_page(spark, sf_dir):
    """The page's eleven questions, recomputed in one job: an error fails all of them."""
    return A.report(A.applicants(spark, sf_dir), A.PAGE_SUBSET, isolated=False)


@query(f"SELECT question, CASE question WHEN 'Q4' THEN NULL ELSE answer END AS answer, CASE question WHEN 'Q4' THEN 'failed' END AS error FROM ({ANSWERS_SQL + OTHER_ANSWERS_SQL}) WHERE question IN ('Q1', 'Q2', 'Q3', 'Q4', 'Q5', 'Q6')", True)
def report_isolated(spark, sf_dir):
    """Six questions, of which one fails when it runs: its row tells so, the others have their answers."""

    def fails(df: DataFrame) -> DataFrame:
        return df.agg(F.max(F.raise_error(F.lit("no such result"))).cast("decimal(20,2)").alias("avg_gpa_us_fall26"))

    questions = {k: A.QUESTIONS[k] for k in A.ORM_SUBSET} | {"Q4": fails}
    found = A.report(A.applicants(spark, sf_dir), A.ORM_SUBSET, questions)
    return found.withColumn("error", F.when(F.col("error").isNotNull(), "failed"))


# ---- sources and sinks ----------------------------------------------------------------------------------------------------

RAW_SQL = "SELECT program, url, status, term, degree, comments FROM applicants"
PER_FILE = 10_000


def _as_raw(spark, sf_dir) -> DataFrame:
    a = A.applicants(spark, sf_dir)
    return a.select("p_id", F.to_json(F.struct("program", "url", "status", "term", "degree", "comments")).alias("row"))


def _json_files(rows: DataFrame, path: str, wrapped: bool = False) -> None:
    """Files of at most PER_FILE results, each one JSON array; if wrapped, every second one as an object with the key rows."""
    listed = rows.groupBy(F.floor(F.col("p_id") / PER_FILE).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ",\n"), F.lit("]")).alias("value"))
    if wrapped:
        listed = listed.withColumn("value", F.when(F.col("part") % 2 == 0, F.concat(F.lit('{"rows": '), F.col("value"), F.lit("}"))).otherwise(F.col("value")))
    listed.write.partitionBy("part").text(path)


FIELDS = ["program", "url", "status", "term", "degree", "comments"]


@query(RAW_SQL + " UNION ALL SELECT 'PATH_NOT_FOUND', NULL, NULL, NULL, NULL, NULL", True)
def source_array(spark, sf_dir):
    """JSON arrays written and read back; a missing file gives no rows and a reason, shown as the last row."""
    where = shared_folder(spark)
    _json_files(_as_raw(spark, sf_dir), f"{where}/in")
    rows, error = S.load_array(spark, f"{where}/in/*/*")
    none, reason = S.load_array(spark, f"{where}/none.json")
    assert error is None
    told = none.select(*FIELDS).unionByName(spark.createDataFrame([(reason, *[None] * 5)], ", ".join(f"{c} string" for c in FIELDS)))
    return rows.select(*FIELDS).unionByName(told)


@query(RAW_SQL, True)
def source_rows(spark, sf_dir):
    """Arrays, and objects that hold one under the key rows."""
    where = shared_folder(spark)
    _json_files(_as_raw(spark, sf_dir), f"{where}/in", wrapped=True)
    return S.read_rows(spark, f"{where}/in/*/*").select(*FIELDS)


def _json_lines(spark, sf_dir) -> str:
    where = shared_folder(spark)
    rows = _as_raw(spark, sf_dir)
    rows.select(F.explode(F.when(F.col("p_id") % 7 == 0, F.array("row", F.lit(""))).otherwise(F.array("row"))).alias("value")).write.text(f"{where}/lines")
    return where


@query(RAW_SQL, True)
def source_lines(spark, sf_dir):
    """JSON Lines with blank lines among them."""
    return S.read_lines(spark, f"{_json_lines(spark, sf_dir)}/lines").select(*FIELDS)


@query(RAW_SQL, True)
def source_convert(spark, sf_dir):
    """JSON Lines converted to another format and read from it."""
    where = _json_lines(spark, sf_dir)
    S.convert(spark, f"{where}/lines", f"{where}/as-orc", to="orc")
    return spark.read.schema(RAW).orc(f"{where}/as-orc").select(*FIELDS)


@query("SELECT o_orderkey, o_custkey FROM orders")
def store_append(spark, sf_dir):
    """A store that grows by two appends."""
    where, o = shared_folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    S.append(o.filter("o_orderkey % 2 = 0"), f"{where}/store")
    S.append(o.filter("o_orderkey % 2 = 1"), f"{where}/store")
    return spark.read.schema(o.schema).parquet(f"{where}/store")


@query("SELECT DISTINCT url FROM (SELECT CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL ELSE 'u' || user_id END AS url FROM events) WHERE url <> ''")
def known_urls(spark, sf_dir):
    url = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return S.known_urls(table(spark, sf_dir, "events").select(url.alias("url")))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 10 = 3)")
def point_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return S.by_key(o, "o_orderkey", o.filter("o_orderkey % 10 = 3").agg(F.max("o_orderkey")).first()[0])


@query("SELECT o_orderkey, o_custkey, 'refused' AS smaller FROM orders")
def publish_guard(spark, sf_dir):
    """Three publications: half the rows, all of them, and a third of them, which is refused."""
    where, o = shared_folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    publish(o.filter("o_orderkey % 2 = 0"), where)
    publish(o, where)
    try:
        publish(o.filter("o_orderkey % 3 = 0"), where)
        smaller = "published"
    except Shrinks:
        smaller = "refused"
    return current(spark, where).withColumn("smaller", F.lit(smaller))


@query("SELECT p_name AS name, count(*) AS n FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1")
def reference_list(spark, sf_dir):
    """A list written with padding and blank lines; a list that does not exist has no names."""
    where, part = shared_folder(spark), table(spark, sf_dir, "part")
    line = F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")))
    part.select(line.alias("value")).write.text(f"{where}/names")
    return S.read_names(spark, f"{where}/names").select("name").unionByName(S.read_names(spark, f"{where}/none").select("name")).groupBy("name").agg(F.count("*").alias("n"))


# ---- predicates and aggregates -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring' OR p_name ILIKE 'RED%' OR p_name ILIKE '%old%'")
def ilike_any(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(X.ilike_any("p_name", ["%ring", "RED%", "%old%"])).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END NOT ILIKE 'machin%'")
def not_ilike(spark, sf_dir):
    seg = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").filter(~seg.ilike("machin%")).select("c_custkey")


@query(r"SELECT p_id, TRY_CAST(nullif(regexp_extract(term, '(\d{4})$', 1), '') AS INT) AS year FROM applicants WHERE regexp_matches(term, '^(Spring|Fall) \d{4}$', 'i') OR p_id % 89 = 0 OR p_id % 97 = 0", True)
def regex_year(spark, sf_dir):
    df = A.applicants(spark, sf_dir).filter(X.matches_ci("term", r"(Spring|Fall) \d{4}") | (F.col("p_id") % 89 == 0) | (F.col("p_id") % 97 == 0))
    return df.select("p_id", X.trailing_year("term").alias("year"))


@query(r"SELECT p_id, regexp_replace(program, '^.*, ', '') AS school FROM applicants WHERE regexp_replace(program, '^.*, ', '') ILIKE '%0\%%' ESCAPE '\'", True)
def last_segment_contains(spark, sf_dir):
    school = X.last_segment("program")
    return A.applicants(spark, sf_dir).filter(X.contains_ci(school, "0%")).select("p_id", school.alias("school"))


@query(f"SELECT o_orderpriority, {PCT(c="o_orderstatus = 'F'")} AS pct_f FROM orders GROUP BY o_orderpriority")
def pct_conditional(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(N.percent_where(F.col("o_orderstatus") == "F").cast("decimal(20,2)").alias("pct_f"))


@query("SELECT l_returnflag, " + ", ".join(f"{AVG2(c=c)} AS avg_{c[2:]}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem GROUP BY l_returnflag")
def avg_multi(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[N.average2(F.col(c)).cast("decimal(20,2)").alias(f"avg_{c[2:]}") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])


@query("SELECT l_shipmode, CAST(round(CAST(n AS DECIMAL(20,0)) * 100 / sum(n) OVER (), 2) AS DECIMAL(20,2)) AS pct FROM (SELECT concat(l_returnflag, l_linestatus) AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1)")
def share_of_total(spark, sf_dir):
    from pyspark.sql import Window as W

    counted = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")).agg(F.count("*").alias("n"))
    return counted.select("l_shipmode", N.percent_of(F.col("n"), F.sum("n").over(W.partitionBy())).cast("decimal(20,2)").alias("pct"))  # a handful of rows


@query("SELECT count(*) FILTER (l_discount > 0.05) AS a, count(*) FILTER (l_tax > 0.05) AS b, count(*) FILTER (l_discount > 0.05) - count(*) FILTER (l_tax > 0.05) AS diff FROM lineitem")
def count_diff(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_discount") > 0.05).alias("a"), F.count_if(F.col("l_tax") > 0.05).alias("b"))
    return one.withColumn("diff", F.col("a") - F.col("b"))


@query("SELECT o_orderstatus, string_agg(concat(p, ': ', n), ', ' ORDER BY p) AS pairs FROM (SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def string_agg_pairs(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p", "n"))), lambda x: F.concat(x["p"], F.lit(": "), x["n"].cast("string")))
    return counted.groupBy("o_orderstatus").agg(F.array_join(listed, ", ").alias("pairs"))


@query("SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) AS rank, p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 25")
def topk_two_keys(spark, sf_dir):
    from pyspark.sql import Window as W

    top = table(spark, sf_dir, "part").orderBy(F.desc("p_size"), F.desc("p_partkey")).limit(A.row_limit(25)).select("p_partkey", "p_size")
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("p_size"), F.desc("p_partkey"))))  # 25 rows


# ---- validation: raw texts made from typed columns, with faults ---------------------------------------------------------


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applicants view as scraped texts. Faults by p_id: 53 empty program, 59 no term, 61 bad date, 67 url without id, 71 GPA out of range, 73 no digits."""
    a = A.applicants(spark, sf_dir)
    k = F.col("p_id")
    fault = lambda n: k % n == 0
    return a.select(
        k.alias("k"),
        F.when(fault(53), "").otherwise(F.col("program")).alias("program"),
        F.when(fault(61), "Added on Sep 31, 2026").when(fault(3), F.date_format("date_added", "MMM d, yyyy")).otherwise(F.concat(F.lit("Added on "), F.date_format("date_added", "MMM  dd, yyyy"))).alias("date added"),
        F.when(fault(67), "https://example.org/none").otherwise(F.col("url")).alias("url"),
        "status",
        F.when(~fault(59), F.col("term")).alias("term"),
        F.when(fault(2), F.concat(F.lit(" "), F.upper("us_or_international"))).otherwise(F.col("us_or_international")).alias("US/International"),
        "degree",
        "comments",
        F.when(fault(71), "GPA 9.99").when(fault(73), "no digits here").otherwise(F.concat(F.lit("GPA "), F.format_string("%.2f", "gpa"))).alias("GPA"),
        F.concat(F.lit("GRE "), F.col("gre").cast("int").cast("string")).alias("GRE score"),
        F.concat(F.lit("GRE V "), F.col("gre_v").cast("int").cast("string")).alias("GRE V score"),
        F.concat(F.lit("GRE AW "), F.col("gre_aw").cast("string")).alias("GRE AW"),
        F.col("llm_generated_program").alias("llm-generated-program"),
        F.col("llm_generated_university").alias("llm-generated-university"),
    )


@query("SELECT p_id AS k, concat_ws(',', CASE WHEN p_id % 53 = 0 THEN 'program' END, CASE WHEN p_id % 59 = 0 THEN 'term' END) AS missing FROM applicants", True)
def required_fields(spark, sf_dir):
    return raw_results(spark, sf_dir).select("k", F.array_join(V.missing_fields(V.REQUIRED), ",").alias("missing"))


@query("SELECT p_id AS k, CASE WHEN p_id % 61 <> 0 THEN date_added END AS date_added FROM applicants", True)
def parse_added_date(spark, sf_dir):
    return raw_results(spark, sf_dir).select("k", X.added_date("`date added`").alias("date_added"))


@query("SELECT p_id AS k, CASE WHEN p_id % 67 <> 0 THEN p_id END AS p_id FROM applicants", True)
def extract_id(spark, sf_dir):
    return raw_results(spark, sf_dir).select("k", X.id_after("url").alias("p_id"))


@query("SELECT p_id AS k, CASE WHEN p_id % 71 <> 0 AND p_id % 73 <> 0 THEN gpa END AS gpa, gre, gre_v, gre_aw FROM applicants", True)
def extract_score(spark, sf_dir):
    return V.converted(raw_results(spark, sf_dir)).select("k", "gpa", "gre", "gre_v", "gre_aw")


@query("SELECT p_id AS k, us_or_international AS origin FROM applicants", True)
def map_category(spark, sf_dir):
    return V.converted(raw_results(spark, sf_dir)).select("k", F.col("us_or_international").alias("origin"))


REJECTS_SQL = """SELECT p_id AS k, CASE WHEN p_id % 67 <> 0 THEN CAST(p_id AS VARCHAR) ELSE 'https://example.org/none' END AS reject_id,
  concat_ws(',', CASE WHEN p_id % 53 = 0 THEN 'program' END, CASE WHEN p_id % 59 = 0 THEN 'term' END, CASE WHEN p_id % 61 = 0 THEN 'date_added' END, CASE WHEN p_id % 67 = 0 THEN 'p_id' END) AS missing
FROM applicants WHERE p_id % 53 = 0 OR p_id % 59 = 0 OR p_id % 61 = 0 OR p_id % 67 = 0"""


@query(REJECTS_SQL, True)
def reject_split(spark, sf_dir):
    return V.converted(raw_results(spark, sf_dir)).filter(F.size("missing") > 0).select("k", "reject_id", F.array_join("missing", ",").alias("missing"))


@query(
    """SELECT p_id, program, comments, date_added, url, status, term, us_or_international, CASE WHEN p_id % 71 <> 0 AND p_id % 73 <> 0 THEN gpa END AS gpa, gre, gre_v, gre_aw, degree, llm_generated_program, llm_generated_university
FROM applicants WHERE NOT (p_id % 53 = 0 OR p_id % 59 = 0 OR p_id % 61 = 0 OR p_id % 67 = 0)""",
    True,
)
def valid_results(spark, sf_dir):
    return V.valid_rows(V.converted(raw_results(spark, sf_dir))).drop("k")


@query(
    """SELECT p_id AS k, CASE WHEN p_id % 61 <> 0 THEN date_added END AS date_added, CAST(NULL AS DOUBLE) AS gpa, CASE WHEN p_id % 2 = 0 THEN concat(' ', upper(us_or_international)) ELSE us_or_international END AS origin,
  concat_ws(',', CASE WHEN p_id % 59 = 0 THEN 'term' END, CASE WHEN p_id % 61 = 0 THEN 'date_added' END, CASE WHEN p_id % 67 = 0 THEN 'p_id' END) AS missing FROM applicants""",
    True,
)
def lenient_rows(spark, sf_dir):
    checked = V.converted(raw_results(spark, sf_dir), V.Rules(lenient=True))
    return checked.select("k", "date_added", "gpa", F.col("us_or_international").alias("origin"), F.array_join("missing", ",").alias("missing"))


FAULTY = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 1000 = 7 THEN 7 ELSE o_orderkey END AS id, 'u' || (o_orderkey // 2 * 2 % 5000) AS url FROM orders"


@query(
    f"""WITH f AS ({FAULTY}) SELECT 'not null: status' AS rule, count(*) FILTER (status IS NULL) AS violations FROM f
UNION ALL SELECT 'not null: id', count(*) FILTER (id IS NULL) FROM f
UNION ALL SELECT 'unique: id', count(*) FROM (SELECT id FROM f GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'unique: url', count(*) FROM (SELECT url FROM f GROUP BY url HAVING count(*) > 1)"""
)
def constraint_report(spark, sf_dir):
    df = on(spark, sf_dir, FAULTY.replace("//", "div").replace("FROM orders", "FROM {orders}"), "orders")
    return V.constraint_report(df, ["status", "id"], ["id", "url"])


SCORES = "SELECT o_orderkey AS k, cast(o_orderkey % 7 as double) AS gpa, cast(100 + o_orderkey % 90 as double) AS gre FROM orders"


@query(f"SELECT k, CASE WHEN gpa BETWEEN 0 AND 4 THEN gpa END AS gpa, CASE WHEN gre BETWEEN 130 AND 170 THEN gre END AS gre FROM ({SCORES})")
def repair_scores(spark, sf_dir):
    return V.repair_ranges(on(spark, sf_dir, SCORES.replace("FROM orders", "FROM {orders}"), "orders"))


@query(f"SELECT count(*) FILTER (gpa NOT BETWEEN 0 AND 4) AS gpa, count(*) FILTER (gre NOT BETWEEN 130 AND 170) AS gre FROM ({SCORES})")
def repair_counts(spark, sf_dir):
    return V.out_of_range(on(spark, sf_dir, SCORES.replace("FROM orders", "FROM {orders}"), "orders"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'Other' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def repair_category(spark, sf_dir):
    return V.repair_category(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["O", "F"])


@query("SELECT count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS changed FROM orders")
def repair_category_count(spark, sf_dir):
    return V.out_of_list(table(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F"])


# ---- merges -----------------------------------------------------------------------------------------------------------------

OLD = "SELECT o_orderkey AS k, o_custkey AS v, o_orderpriority AS w FROM orders WHERE o_orderkey % 3 <> 0"
NEW = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey + 1 END AS v, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS w FROM orders WHERE o_orderkey % 2 = 0"
MERGED = f"SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN n.v ELSE o.v END AS v, coalesce(n.w, o.w) AS w, CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'unchanged' ELSE 'updated' END AS action FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k"


def _merged(spark, sf_dir):
    old, new = (on(spark, sf_dir, s.replace("FROM orders", "FROM {orders}"), "orders") for s in (OLD, NEW))
    return U.upsert(old, new, "k", fixed=("v",))


@query(f"SELECT k, v, w FROM ({MERGED})")
def upsert_coalesce(spark, sf_dir):
    return _merged(spark, sf_dir).drop("action")


@query(f"SELECT action, count(*) AS n FROM ({MERGED}) GROUP BY action")
def upsert_actions(spark, sf_dir):
    return _merged(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query(
    f"""SELECT * FROM (SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated FROM ({MERGED})),
  (SELECT count(*) AS skipped FROM orders WHERE o_orderkey % 101 = 0),
  (SELECT string_agg(id, ',' ORDER BY id) AS skipped_ids FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 101 = 0 ORDER BY 1 LIMIT 100))"""
)
def load_summary(spark, sf_dir):
    skipped = table(spark, sf_dir, "orders").filter("o_orderkey % 101 = 0").select(F.col("o_orderkey").cast("string").alias("reject_id"))
    return V.load_summary(_merged(spark, sf_dir), skipped)


@query(f"SELECT k, v, w FROM ({MERGED})")
def upsert_twice(spark, sf_dir):
    """The same rows merged twice: the second time changes nothing."""
    new = on(spark, sf_dir, NEW.replace("FROM orders", "FROM {orders}"), "orders")
    return U.upsert(_merged(spark, sf_dir).drop("action"), new, "k", fixed=("v",)).drop("action")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def key_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return U.key_union("o_custkey", o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"))


LOADED = """SELECT p_id, program, CASE WHEN p_id % 7 = 0 AND p_id % 2 = 0 THEN 'first' ELSE comments END AS comments, date_added, url, status, term, us_or_international,
  coalesce(CASE WHEN p_id % 71 <> 0 AND p_id % 73 <> 0 THEN gpa END, CASE WHEN p_id % 2 = 0 THEN 1.5 END) AS gpa, gre, gre_v, gre_aw, degree, llm_generated_program, llm_generated_university
FROM applicants WHERE NOT (p_id % 53 = 0 OR p_id % 59 = 0 OR p_id % 61 = 0 OR p_id % 67 = 0)"""


def _two_loads(spark, sf_dir):
    """Even results with a first comment and GPA, then all results: values that are missing the second time stay."""
    results, raw = results_table(spark, shared_folder(spark), 16), raw_results(spark, sf_dir)
    load_results(raw.filter("k % 2 = 0").withColumns({"comments": F.lit("first"), "GPA": F.lit("GPA 1.50")}), results, "k")
    return results, load_results(raw, results, "k")


@query(LOADED, True)
def load_pipeline(spark, sf_dir):
    return _two_loads(spark, sf_dir)[0].read()


@query(
    """SELECT count(*) FILTER (ok AND p_id % 2 <> 0) AS inserted, count(*) FILTER (ok AND p_id % 2 = 0) AS updated, count(*) FILTER (NOT ok) AS skipped
FROM (SELECT p_id, NOT (p_id % 53 = 0 OR p_id % 59 = 0 OR p_id % 61 = 0 OR p_id % 67 = 0) AS ok FROM applicants)""",
    True,
)
def load_pipeline_summary(spark, sf_dir):
    return _two_loads(spark, sf_dir)[1].summary


VALUES = "SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v, CASE WHEN event_id % 7 <> 0 THEN event_type END AS w FROM events"


@query(f"SELECT user_id, arg_max(v, event_id) FILTER (v IS NOT NULL) AS v, arg_max(w, event_id) FILTER (w IS NOT NULL) AS w, min(event_id) AS event_id FROM ({VALUES}) GROUP BY user_id")
def dedup_last_nonnull(spark, sf_dir):
    return U.last_non_null(on(spark, sf_dir, VALUES.replace("FROM events", "FROM {events}"), "events"), "user_id", "event_id")


HELD = "SELECT 'u' || c_custkey AS url, c_custkey AS id FROM customer WHERE c_custkey % 3 = 0"
COMING = "SELECT 'u' || CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE o_orderkey + 1000000 END AS url, o_custkey AS id, o_orderkey AS seq FROM orders WHERE o_orderkey % 5 = 0"
ONE_EACH = "SELECT url, arg_max(id, seq) AS id, min(seq) AS seq FROM ({}) GROUP BY url"


@query(
    f"""WITH h AS ({HELD}), n AS ({ONE_EACH.format(COMING)}), fresh AS (SELECT * FROM n WHERE url NOT IN (SELECT url FROM h))
SELECT url, id, seq FROM fresh WHERE id IN (SELECT id FROM h)
UNION ALL SELECT url, id, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM fresh WHERE id NOT IN (SELECT id FROM h)) WHERE r > 1"""
)
def key_conflicts(spark, sf_dir):
    held = on(spark, sf_dir, HELD.replace("FROM customer", "FROM {customer}"), "customer")
    new = U.last_non_null(on(spark, sf_dir, COMING.replace("FROM orders", "FROM {orders}"), "orders"), "url", "seq")
    return U.key_conflicts(held, new, "url", "id", "seq").select("url", "id", "seq")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE user_id % 3 <> 0) WHERE r = 1")
def insert_ignore(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return U.insert_ignore(events.filter("user_id % 3 = 0").select("user_id").distinct(), events, "user_id", "event_id")


def _load(spark, sf_dir, since=None):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    marks = spark.createDataFrame([("feed", "1500", None), ("other", "9", None)], MARKS)
    return K.incremental(events.filter("event_id < 1000 or event_id % 1000 = 0"), events.filter("event_id >= 800 and event_id % 2 = 0"), marks, "feed", "event_id", "user_id", since)


@query("SELECT event_id, user_id FROM events WHERE event_id > 1500 AND event_id % 2 = 0 AND event_id % 1000 <> 0")
def incremental_load(spark, sf_dir):
    return _load(spark, sf_dir)[0]


@query("SELECT event_id, user_id FROM events WHERE event_id > 900 AND event_id % 2 = 0 AND event_id >= 1000 AND event_id % 1000 <> 0")
def incremental_since(spark, sf_dir):
    return _load(spark, sf_dir, 900)[0]


@query("SELECT 'feed' AS source, CAST(greatest(1500, max(event_id)) AS VARCHAR) AS last_seen FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'other', '9'")
def watermark_upsert(spark, sf_dir):
    return _load(spark, sf_dir)[1].select("source", "last_seen")


DONE = "SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % {} = 0"


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def resume_antijoin(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return U.resume(o, o.filter("o_orderkey % 3 = 0"), "o_orderkey")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'later' WHEN o_orderkey % 3 = 0 THEN 'earlier' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def merge_precedence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return U.newest_by_key("k", o.filter("k % 2 = 0"), o.filter("k % 3 = 0").withColumn("v", F.lit("earlier")), o.filter("k % 6 = 0").withColumn("v", F.lit("later")))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderkey % 2 = 0) AS completed, count(*) FILTER (o_orderkey % 2 <> 0) AS remaining, count(*) FILTER (o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0) AS failed FROM orders")
def enrich_progress(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return U.progress(o, o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), "o_orderkey")


# ---- names --------------------------------------------------------------------------------------------------------------------

MESSY = "SELECT p_id, CASE p_id % 6 WHEN 0 THEN program WHEN 1 THEN replace(program, ', ', ' @ ') WHEN 2 THEN replace(program, ', ', ' at ') WHEN 3 THEN upper(program) WHEN 4 THEN 'just one-part' END AS raw FROM applicants"
TITLE = "list_reduce(list_transform(regexp_extract_all({0}, '[a-zA-Z]+|[^a-zA-Z]+'), lambda x: concat(upper(x[1]), lower(x[2:]))), lambda a, b: concat(a, b))".format


def _messy(spark, sf_dir):
    return spark.sql(MESSY.replace("FROM applicants", "FROM {applicants}"), applicants=A.applicants(spark, sf_dir))


PARTS = r"list_filter(list_transform(regexp_split_to_array(coalesce(raw, ''), ',| at | @ '), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT p_id, coalesce({TITLE('p[1]')}, '') AS program, regexp_replace(coalesce({TITLE('p[2]')}, ''), '\\bOf\\b', 'of', 'g') AS university FROM (SELECT p_id, {PARTS} AS p FROM ({MESSY}))", True)
def split_program(spark, sf_dir):
    program, university = M.split_name(F.col("raw"))
    return _messy(spark, sf_dir).select("p_id", program.alias("program"), university.alias("university"))


@query(f"SELECT p_id, {TITLE('raw')} AS title FROM ({MESSY})", True)
def title_case(spark, sf_dir):
    return _messy(spark, sf_dir).select("p_id", X.title_case("raw").alias("title"))


SHORT = "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'ubc' WHEN 1 THEN 'U.B.C.' WHEN 2 THEN 'McG' WHEN 3 THEN 'uoft' WHEN 4 THEN 'mcgill' ELSE c_mktsegment END AS s FROM customer"


@query(f"SELECT c_custkey, CASE WHEN lower(s) IN ('mcg', 'mcg.', 'mcgill') THEN 'McGill University' WHEN lower(s) IN ('ubc', 'u.b.c.') THEN 'University of British Columbia' WHEN lower(s) = 'uoft' THEN 'University of Toronto' ELSE s END AS name FROM ({SHORT})")
def abbrev_expand(spark, sf_dir):
    return on(spark, sf_dir, SHORT.replace("FROM customer", "FROM {customer}"), "customer").select("c_custkey", M.expanded(F.col("s")).alias("name"))


CANON = "SELECT name, min(p_partkey) AS line FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS name FROM part WHERE length(p_name) % 2 = 0) GROUP BY name"


def _canon(spark, sf_dir):
    return M.lookup_map(on(spark, sf_dir, CANON.replace("FROM part", "FROM {part}"), "part"))


@query(f"SELECT p_partkey, canonical FROM part LEFT JOIN (SELECT lower(name) AS k, arg_max(name, line) AS canonical FROM ({CANON}) GROUP BY 1) ON lower(p_name) = k")
def canon_exact(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.join(_canon(spark, sf_dir), F.lower("p_name") == F.col("k"), "left").select("p_partkey", "canonical")


@query(f"SELECT p_name AS name, count(*) AS n FROM part WHERE lower(p_name) NOT IN (SELECT lower(name) FROM ({CANON})) GROUP BY p_name")
def unmatched_report(spark, sf_dir):
    return M.unmatched_report(table(spark, sf_dir, "part"), "p_name", _canon(spark, sf_dir))


TYPOS = "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN concat(p_name, 's') WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN replace(p_name, 'e', 'a') ELSE concat(p_brand, p_name) END AS name FROM part"


@query(
    f"""WITH n AS ({TYPOS}), c AS (SELECT lower(name) AS k, arg_max(name, line) AS canonical FROM ({CANON}) GROUP BY 1), s AS (
  SELECT n.name, c.canonical, c.k, 1 - levenshtein(lower(n.name), c.k) / greatest(length(n.name), length(c.k)) AS score FROM n, c)
SELECT name, canonical, score FROM s WHERE score >= 0.84 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, k DESC) = 1"""
)
def fuzzy_levenshtein(spark, sf_dir):
    return M.fuzzy_matches(on(spark, sf_dir, TYPOS.replace("FROM part", "FROM {part}"), "part"), _canon(spark, sf_dir), 0.84, "levenshtein")


def best_ratio(names: str, cutoff: float, before: str = "") -> str:
    """CTEs up to best (name, canonical, k, score): the longest blocks of all pairs, and of what lies left and right of them, found together.

    Runs of equal characters on a diagonal are islands; the longest is a segment's block, the earliest in the first text and then in the second.
    """
    bound = f">= {cutoff} * (length(k) + length(name))"
    shared = "list_sum(list_transform(list_distinct(string_split(k, '')), lambda x: least(length(k) - length(replace(k, x, '')), length(name) - length(replace(lower(name), x, '')))))"
    return f"""WITH RECURSIVE c AS (SELECT lower(name) AS k, arg_max(name, line) AS canonical FROM ({CANON}) GROUP BY 1), {before} n AS ({names}),
pairs AS (SELECT name, k, lower(name) AS b FROM n, c WHERE name <> '' AND k <> '' AND 2 * least(length(k), length(name)) {bound} AND 2 * {shared} {bound}),
seg(name, k, step, a, b, m) AS (
  SELECT name, k, '', k, b, 0 FROM pairs
  UNION ALL
  SELECT name, k, step || side, CASE side WHEN 'l' THEN a[:i - 1] ELSE a[i + size:] END, CASE side WHEN 'l' THEN b[:j - 1] ELSE b[j + size:] END, CASE side WHEN 'l' THEN size ELSE 0 END
  FROM (
    SELECT name, k, step, any_value(a) AS a, any_value(b) AS b, arg_min({{'i': i, 'j': j, 'size': size}}, (-size, i, j)) AS block FROM (
      SELECT name, k, step, a, b, min(i) AS i, min(j) AS j, count(*) AS size FROM (
        SELECT *, i - row_number() OVER (PARTITION BY name, k, step, i - j ORDER BY i) AS island FROM (
          SELECT *, unnest(generate_series(1, length(b))) AS j FROM (SELECT name, k, step, a, b, unnest(generate_series(1, length(a))) AS i FROM seg WHERE a <> '' AND b <> '')
        ) WHERE a[i] = b[j]
      ) GROUP BY name, k, step, a, b, i - j, island
    ) GROUP BY name, k, step
  ), LATERAL (SELECT block.i AS i, block.j AS j, block.size AS size), LATERAL (SELECT unnest(['l', 'r']) AS side)
),
scored AS (SELECT name, k, 2.0::DOUBLE * sum(m) / (length(k) + length(name)) AS score FROM seg GROUP BY name, k),
best AS (SELECT name, canonical, k, score FROM scored JOIN c USING (k) WHERE score >= {cutoff} QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, k DESC) = 1)
"""


@query(best_ratio(TYPOS, 0.84) + "SELECT name, canonical, score FROM best")
def fuzzy_ratio(spark, sf_dir):
    return M.fuzzy_matches(on(spark, sf_dir, TYPOS.replace("FROM part", "FROM {part}"), "part"), _canon(spark, sf_dir), 0.84, "ratio")


def standard_ratio(raw: str, rule: str, cutoff: float) -> str:
    rules = f"r AS (SELECT DISTINCT raw, {rule} AS name FROM ({raw})), e AS (SELECT raw, name, canonical FROM r LEFT JOIN c ON lower(name) = k),"
    best = best_ratio("SELECT DISTINCT name FROM e WHERE canonical IS NULL AND name <> ''", cutoff, rules)
    return best + f"SELECT p_partkey, w.raw, coalesce(e.canonical, best.canonical, e.name) AS standard FROM ({raw}) w JOIN e ON w.raw IS NOT DISTINCT FROM e.raw LEFT JOIN best ON e.name = best.name"


STANDARD_SQL = """WITH c AS (SELECT lower(name) AS k, arg_max(name, line) AS canonical FROM ({canon}) GROUP BY 1), n AS (SELECT DISTINCT raw, {rule} AS name FROM ({raw})),
e AS (SELECT raw, name, canonical FROM n LEFT JOIN c ON lower(name) = k), s AS (
  SELECT e.name, c.canonical AS near, c.k, 1 - levenshtein(lower(e.name), c.k) / greatest(length(e.name), length(c.k)) AS score FROM (SELECT DISTINCT name FROM e WHERE canonical IS NULL AND name <> '') e, c),
b AS (SELECT name, near FROM s WHERE score >= {cutoff} QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, k DESC) = 1)
SELECT p_partkey, r.raw, coalesce(canonical, near, e.name) AS standard FROM ({raw}) r JOIN e ON r.raw IS NOT DISTINCT FROM e.raw LEFT JOIN b ON e.name = b.name"""
PROGRAMS = "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN ' Mathematic ' WHEN 1 THEN NULL WHEN 2 THEN concat(p_name, 's') WHEN 3 THEN 'Info Studies' ELSE p_name END AS raw FROM part"
SCHOOLS = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'u.b.c.' WHEN 1 THEN NULL WHEN 2 THEN concat(p_name, 'e') WHEN 3 THEN 'McGiill University' WHEN 4 THEN ' university Of life' WHEN 5 THEN 'Mcg' ELSE p_name END AS raw FROM part"
PROGRAM_RULE = "nullif(trim(raw), '')"
PROGRAM_RULE = f"CASE {PROGRAM_RULE} WHEN 'Mathematic' THEN 'Mathematics' WHEN 'Info Studies' THEN 'Information Studies' ELSE coalesce({TITLE(PROGRAM_RULE)}, '') END"
SCHOOL_RULE = "nullif(trim(raw), '')"
SCHOOL_RULE = f"CASE WHEN lower({SCHOOL_RULE}) = 'u.b.c.' THEN 'University of British Columbia' WHEN {SCHOOL_RULE} IN ('McGiill University', 'Mcg') THEN 'Mcgill University' ELSE regexp_replace(coalesce({TITLE(SCHOOL_RULE)}, ''), '\\bOf\\b', 'of', 'g') END"


BRANDS = "SELECT p_partkey, concat(p_name, CASE WHEN p_partkey % 5 = 0 THEN 's' ELSE '' END) AS raw FROM part"


@query(standard_ratio(BRANDS, PROGRAM_RULE, 0.84))
def standardise_names(spark, sf_dir):
    """Rules, exact and fuzzy look-ups composed over the parts' names."""
    return M.standardised(on(spark, sf_dir, BRANDS.replace("FROM part", "FROM {part}"), "part"), "raw", _canon(spark, sf_dir), "program").select("p_partkey", "raw", "standard")


@query(standard_ratio(PROGRAMS, PROGRAM_RULE, 0.84))
def standardise_programs_ratio(spark, sf_dir):
    """The program pipeline with the Ratcliff-Obershelp score."""
    return M.standardised(on(spark, sf_dir, PROGRAMS.replace("FROM part", "FROM {part}"), "part"), "raw", _canon(spark, sf_dir), "program").select("p_partkey", "raw", "standard")


@query(standard_ratio(SCHOOLS, SCHOOL_RULE, 0.86))
def standardise_universities_ratio(spark, sf_dir):
    """The university pipeline with the Ratcliff-Obershelp score."""
    return M.standardised(on(spark, sf_dir, SCHOOLS.replace("FROM part", "FROM {part}"), "part"), "raw", _canon(spark, sf_dir), "university").select("p_partkey", "raw", "standard")


@query(STANDARD_SQL.format(canon=CANON, rule=PROGRAM_RULE, raw=PROGRAMS, cutoff=0.84))
def standardise_programs(spark, sf_dir):
    """The program pipeline with the built-in score."""
    raw = on(spark, sf_dir, PROGRAMS.replace("FROM part", "FROM {part}"), "part")
    return M.standardised(raw, "raw", _canon(spark, sf_dir), "program", "levenshtein").select("p_partkey", "raw", "standard")


@query(STANDARD_SQL.format(canon=CANON, rule=SCHOOL_RULE, raw=SCHOOLS, cutoff=0.86))
def standardise_universities(spark, sf_dir):
    """The university pipeline with the built-in score: abbreviations, fixes, title case, exact and fuzzy look-ups."""
    raw = on(spark, sf_dir, SCHOOLS.replace("FROM part", "FROM {part}"), "part")
    return M.standardised(raw, "raw", _canon(spark, sf_dir), "university", "levenshtein").select("p_partkey", "raw", "standard")


@query("SELECT p_name AS name, upper(p_name) AS llm_generated_program, CAST(length(p_name) AS VARCHAR) AS llm_generated_university, count(*) AS n FROM part GROUP BY p_name")
def enrich_plugin(spark, sf_dir):
    """A predictor of the caller's own, over distinct names in four chunks."""

    def predictor(batches):
        for b in batches:
            yield b.assign(program=b["name"].str.upper(), university=b["name"].str.len().astype(str))

    named = M.enriched(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "name", predictor, partitions=4)
    return named.groupBy("name", "llm_generated_program", "llm_generated_university").agg(F.count("*").alias("n"))


@query(
    r"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Click' WHEN event_id % 4 = 1 THEN event_type WHEN event_id % 4 = 2 THEN event_type ELSE 'Click' END AS program,
  CASE WHEN event_id % 4 = 0 THEN 'Some University' WHEN event_id % 4 = 1 THEN 'U ' || user_id WHEN event_id % 4 = 2 THEN 'click, some university' ELSE 'Some University' END AS university FROM events"""
)
def parse_model_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    obj = F.concat(F.lit('{"program": "'), F.col("event_type"), F.lit('", "university": "U '), F.col("user_id").cast("string"), F.lit('"'))
    body = F.when(F.col("event_id") % 4 == 0, "no answer").when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure: "), obj)).when(F.col("event_id") % 4 == 2, F.concat(F.lit('x {"program": "'), F.col("event_type"), F.lit('",\n "university": ""} y')))
    program, university = M.parsed_output(body, F.lit("click, some university"))
    return e.select("event_id", program.alias("program"), university.alias("university"))


@query(f"SELECT p_id, coalesce({TITLE('p[1]')}, '') AS llm_generated_program, regexp_replace(coalesce({TITLE('p[2]')}, ''), '\\bOf\\b', 'of', 'g') AS llm_generated_university FROM (SELECT p_id, {PARTS} AS p FROM ({MESSY}))", True)
def enrich_batch(spark, sf_dir):
    return M.enriched(_messy(spark, sf_dir), "raw").select("p_id", "llm_generated_program", "llm_generated_university")


# ---- pages --------------------------------------------------------------------------------------------------------------------


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten results a page as table markup, with a classed row first on each page; one of 17 lacks details, one of 3 has a comment."""
    a, k = A.applicants(spark, sf_dir), F.col("p_id")
    td = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    div = lambda x: F.coalesce(F.concat(F.lit("<div>"), x, F.lit("</div>")), F.lit(""))
    school, program = X.last_segment("program"), F.regexp_extract("program", r"^([^,]*), ", 1)
    main = F.concat(F.lit("<tr>"), td(F.lit("<div>"), school, F.lit("</div>")), td(F.lit("<span>"), program, F.lit("</span> <span>"), F.when(F.col("degree") == "Masters", "MS").otherwise(F.col("degree")), F.lit("</span>")), td(F.date_format("date_added", "MMM dd, yyyy")), td(F.col("status")), td(F.lit('<a href="/result/'), k.cast("string"), F.lit('">see</a>')), F.lit("</tr>"))
    gpa = F.concat(F.lit("GPA "), F.format_string("%.2f", "gpa"))
    tags = F.concat(F.lit('<tr class="tw-border-none"><td><div><div>'), F.col("term"), F.lit("</div>"), div(F.col("us_or_international")), div(F.when(k % 2 == 0, F.col("status"))), div(F.when(F.col("gpa").isNotNull(), gpa)), div(F.concat(F.lit("GRE V "), F.col("gre_v").cast("int").cast("string"))), div(F.concat(F.lit("GRE "), F.col("gre").cast("int").cast("string"))), div(F.concat(F.lit("GRE AW "), F.format_string("%.1f", "gre_aw"))), F.lit("</div></td></tr>"))
    note = F.when(k % 3 == 0, F.concat(F.lit('<tr class="tw-border-none"><td><p>Tom &amp; '), k.cast("string"), F.lit("</p></td></tr>"))).otherwise("")
    one = F.concat(main, F.when(k % 17 == 0, "").otherwise(F.concat(tags, note)))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, one.alias("html")))), lambda x: x["html"]), "\n")
    return a.groupBy(F.floor(k / 10).alias("page_id")).agg(F.concat(F.lit('<table><tr class="head"><td>x</td></tr>'), listed, F.lit("</table>")).alias("html")).withColumn("url", F.lit("https://example.org/list?page=1"))


@query(
    r"""SELECT p_id // 10 AS page_id, program, CASE WHEN p_id % 3 = 0 AND p_id % 17 <> 0 THEN concat('Tom & ', p_id) END AS comments, strftime(date_added, '%b %d, %Y') AS date_added, concat('https://example.org/result/', p_id) AS url, status,
  CASE WHEN p_id % 17 <> 0 THEN term END AS term, CASE WHEN p_id % 17 <> 0 THEN us_or_international END AS us_or_international, CASE WHEN p_id % 17 <> 0 THEN concat('GPA ', printf('%.2f', gpa)) END AS gpa,
  CASE WHEN p_id % 17 <> 0 THEN 'GRE ' || CAST(gre AS INT) END AS gre, CASE WHEN p_id % 17 <> 0 THEN 'GRE V ' || CAST(gre_v AS INT) END AS gre_v, CASE WHEN p_id % 17 <> 0 THEN 'GRE AW ' || printf('%.1f', gre_aw) END AS gre_aw, degree,
  CASE WHEN p_id % 17 = 0 THEN 0 WHEN p_id % 3 = 0 THEN 2 ELSE 1 END AS n_details FROM applicants""".replace("concat('GPA ', printf('%.2f', gpa))", "'GPA ' || printf('%.2f', gpa)"),
    True,
)
def html_rows_grouped(spark, sf_dir):
    return H.records(result_pages(spark, sf_dir)).drop("pos")


@query(
    """SELECT p_id, program, CASE WHEN p_id % 3 = 0 THEN concat('Tom & ', p_id) END AS comments, date_added, url, status, term, us_or_international, gpa, gre, gre_v, gre_aw, degree
FROM applicants WHERE p_id % 17 <> 0 AND term IS NOT NULL""",
    True,
)
def pages_to_results(spark, sf_dir):
    """Result pages read, and their records checked and converted like raw results."""
    checked = V.converted(H.raw_records(result_pages(spark, sf_dir)))
    return V.valid_rows(checked).select("p_id", "program", "comments", "date_added", "url", "status", "term", "us_or_international", "gpa", "gre", "gre_v", "gre_aw", "degree")


DECODE = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))".format


@query(f"SELECT page_id, {DECODE("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages")
def page_titles(spark, sf_dir):
    return H.page_titles(table(spark, sf_dir, "pages"))


@query(
    r"""SELECT page_id, CAST(i - 1 AS INT) AS pos, CASE WHEN l[i][1] = '/' THEN concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1), l[i]) ELSE l[i] END AS link
FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\b[^>]*?\shref="([^"]*)"', 1) AS l FROM pages))"""
)
def page_links_resolved(spark, sf_dir):
    return H.page_links(table(spark, sf_dir, "pages"))


# ---- paged feed -----------------------------------------------------------------------------------------------------------------

FEED = "SELECT CAST(floor(event_id / 20) AS BIGINT) AS page_no, event_id % 20 AS pos, CASE WHEN event_id % 77 = 0 THEN NULL ELSE 'u' || (event_id * 7 % 4001) END AS url FROM events"
SEEN = "SELECT DISTINCT 'u' || (event_id % 1500) AS url FROM events WHERE event_id % 3 = 0"
FLAGGED = f"SELECT f.*, url IS NULL OR (url NOT IN (SELECT url FROM ({SEEN})) AND page_no = min(page_no) OVER (PARTITION BY url)) AS is_new FROM ({FEED}) f"
STREAKS = f"""SELECT page_no, n_read, n_new, streak, total_read, total_new FROM (
  SELECT page_no, count(*) AS n_read, count(*) FILTER (is_new) AS n_new, CAST(arg_max(streak, pos) AS BIGINT) AS streak, CAST(sum(count(*)) OVER (ORDER BY page_no) AS BIGINT) AS total_read, CAST(sum(count(*) FILTER (is_new)) OVER (ORDER BY page_no) AS BIGINT) AS total_new
  FROM (SELECT *, count(*) OVER (PARTITION BY g ORDER BY page_no, pos) - CASE WHEN g = 0 THEN 0 ELSE 1 END AS streak FROM (SELECT *, count(*) FILTER (is_new) OVER (ORDER BY page_no, pos) AS g FROM ({FLAGGED})))
  GROUP BY page_no)"""
UNIQUES = f"SELECT page_no, CAST(sum(count(DISTINCT url) FILTER (is_new)) OVER (ORDER BY page_no) + (SELECT count(*) FROM ({SEEN})) AS BIGINT) AS unique_total FROM ({FLAGGED}) GROUP BY page_no"


def _feed(spark, sf_dir):
    f, s = (on(spark, sf_dir, q.replace("FROM events", "FROM {events}"), "events") for q in (FEED, SEEN))
    return C.flagged_new(f, s), s


@query(FLAGGED)
def feed_new_rows(spark, sf_dir):
    return _feed(spark, sf_dir)[0]


@query(f"SELECT * FROM ({STREAKS}) JOIN ({UNIQUES}) USING (page_no)")
def feed_totals(spark, sf_dir):
    flagged, seen = _feed(spark, sf_dir)
    return C.pages(flagged, seen.count())


@query(f"SELECT *, (SELECT min(page_no) FROM ({STREAKS}) WHERE streak >= 40) AS stop_page FROM ({STREAKS}) JOIN ({UNIQUES}) USING (page_no)")
def stream_feed(spark, sf_dir):
    """The feed in three micro-batches, cut in the middle of streaks: totals, streaks and seen urls go on from batch to batch."""
    where = shared_folder(spark)
    f, s = (on(spark, sf_dir, q.replace("FROM events", "FROM {events}"), "events") for q in (FEED, SEEN))
    seen = seen_urls(spark, f"{where}/seen", 16)
    seen.merge(s.select("url", F.lit(None).cast("long").alias("page_no")))
    last = f.agg(F.max("page_no")).first()[0]
    for n in range(3):
        f.filter(F.floor(F.col("page_no") * 3 / F.lit(last + 1)) == n).write.parquet(f"{where}/in/part={n}")
        run_feed(spark.readStream.schema(f.schema).parquet(f"{where}/in/part=*").select(*f.columns), seen, f"{where}/pages", f"{where}/checkpoint", limit=40)
    per = spark.read.parquet(f"{where}/pages").drop("batch")
    return per.withColumn("stop_page", F.lit(seen.version().marks.get("stop")).cast("long"))


@query(f"SELECT page_no, pos FROM ({FEED}) WHERE page_no <= coalesce((SELECT min(page_no) FROM ({STREAKS}) WHERE streak >= 40), 1000000000)")
def feed_streak_cut(spark, sf_dir):
    flagged, _ = _feed(spark, sf_dir)
    return C.until_streak(flagged, C.pages(flagged), 40).select("page_no", "pos")


@query(f"SELECT page_no, pos FROM ({FEED}) WHERE page_no <= coalesce((SELECT min(page_no) FROM ({UNIQUES}) WHERE unique_total >= 2000), 1000000000)")
def feed_quota(spark, sf_dir):
    flagged, seen = _feed(spark, sf_dir)
    return C.until_quota(flagged, C.pages(flagged, seen.count()), 2000).select("page_no", "pos")


# ---- streams --------------------------------------------------------------------------------------------------------------------

KINDS = ["click", "purchase"]


def _messages(spark, sf_dir, where: str) -> None:
    e = table(spark, sf_dir, "events")
    body = message(F.col("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 5 != 0, F.from_json("props", "map<string,string>")))
    body = F.when(F.col("event_id") % 11 == 0, "not-json{{").when(F.col("event_id") % 13 == 0, "[1, 2]").otherwise(body)
    write_messages(e.select(body.alias("value")).repartition(4), where)


def _run_stream(spark, sf_dir) -> str:
    where = shared_folder(spark)
    _messages(spark, sf_dir, f"{where}/in")

    def handle(kind: str):
        return lambda df, number: df.select("kind", F.col("payload")["k"].cast("long").alias("k")).write.mode("overwrite").parquet(f"{where}/out/{kind}/batch={number}")

    T.run_tasks(message_stream(spark, f"{where}/in", 2), {k: handle(k) for k in KINDS}, f"{where}/quarantine", f"{where}/checkpoint")
    return where


@query("SELECT event_type AS kind, count(*) AS n, CAST(sum(CASE WHEN event_id % 5 <> 0 THEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END) AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'purchase') AND event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY event_type")
def task_routing(spark, sf_dir):
    where = _run_stream(spark, sf_dir)
    done = spark.read.schema("kind string, k long").parquet(*[f"{where}/out/{k}/*" for k in KINDS])
    return done.groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("SELECT CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'malformed' ELSE 'unknown kind' END AS reason, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'purchase') OR event_id % 11 = 0 OR event_id % 13 = 0 GROUP BY 1")
def task_quarantine(spark, sf_dir):
    where = _run_stream(spark, sf_dir)
    return spark.read.schema("raw string, reason string").parquet(f"{where}/quarantine/*").groupBy("reason").agg(F.count("*").alias("n"))


@query(
    """SELECT o_custkey, arg_max(s, o_orderkey % 3 * 10000000000 + o_orderkey) FILTER (s IS NOT NULL) AS s, min(o_orderkey % 3 * 10000000000 + o_orderkey) AS first_seq
FROM (SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS s FROM orders) GROUP BY o_custkey"""
)
def stream_upsert(spark, sf_dir):
    """Three parts, each a micro-batch of one checkpoint, merged by key; equal to one batch over all rows in order."""
    where = shared_folder(spark)
    seq = F.col("o_orderkey") % 3 * 10_000_000_000 + F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", seq.alias("seq"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("s"))
    merged = KeyedTable(spark, f"{where}/table", rows.schema, "o_custkey", 16)
    for n in range(3):
        rows.filter(F.floor(F.col("seq") / 10_000_000_000) == n).write.parquet(f"{where}/in/part={n}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{where}/in/part=*")
        T.run_upserts(stream.select(*rows.columns), merged, "seq", ("seq",), f"{where}/checkpoint")
    return merged.read().select("o_custkey", "s", F.col("seq").alias("first_seq"))


@query("SELECT CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'malformed' WHEN event_type = 'purchase' THEN 'failed: ValueError' ELSE 'unknown kind' END AS reason, count(*) AS n FROM events WHERE event_type <> 'click' OR event_id % 11 = 0 OR event_id % 13 = 0 GROUP BY 1")
def task_failures(spark, sf_dir):
    """A handler that fails sends its tasks to quarantine, and the stream goes on with the next batch."""
    where = shared_folder(spark)
    _messages(spark, sf_dir, f"{where}/in")

    def fails(df: DataFrame, number: int) -> None:
        raise ValueError("no purchases today")

    def counts(df: DataFrame, number: int) -> None:
        df.select("kind").write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    T.run_tasks(message_stream(spark, f"{where}/in", 2), {"click": counts, "purchase": fails}, f"{where}/quarantine", f"{where}/checkpoint")
    return spark.read.schema("raw string, reason string").parquet(f"{where}/quarantine/*").groupBy("reason").agg(F.count("*").alias("n"))


FIRST_FEED, SECOND_FEED = "event_id < 2000 AND event_id % 2 = 0", "event_id BETWEEN 1500 AND 4000"


@query(f"SELECT event_id, user_id FROM events WHERE ({FIRST_FEED}) OR ({SECOND_FEED} AND event_id > (SELECT max(event_id) FROM events WHERE {FIRST_FEED})) OR event_id > 1000")
def stream_incremental(spark, sf_dir):
    """Three messages, each asking for a load of its feed: two above the mark, the last one from an id that it names."""
    where, events = shared_folder(spark), table(spark, sf_dir, "events").select("event_id", "user_id")
    stored = KeyedTable(spark, f"{where}/store", events.schema, "event_id", 16)
    load = T.incremental_loads(stored, spark.read.schema(events.schema).parquet, "feed", "user_id")
    for n, rows in enumerate((events.filter(FIRST_FEED), events.filter(SECOND_FEED), events)):
        rows.write.parquet(f"{where}/feed/{n}")
        payload = F.create_map(F.lit("path"), F.lit(f"{where}/feed/{n}"), *([F.lit("since"), F.lit("1000")] if n == 2 else []))
        one = spark.range(1).select(message(F.lit("scrape_new_data"), F.lit(f"2026-01-0{n + 1}T00:00:00"), payload).alias("value"))
        write_messages(one, f"{where}/in")
        T.run_messages(message_stream(spark, f"{where}/in", 10), stored, {"scrape_new_data": load}, f"{where}/quarantine", f"{where}/checkpoint")
    return stored.read()


@query(ANSWERS_SQL, True)
def stream_report(spark, sf_dir):
    """Results that arrive in two parts: after each the report is made anew; this is the last one."""
    where = shared_folder(spark)
    rows = A.applicants(spark, sf_dir).withColumn("seq", F.col("p_id").cast("long"))

    merged = KeyedTable(spark, f"{where}/table", rows.schema, "url", 16)

    def report(held: KeyedTable, number: int) -> None:
        A.report(held.read(), ["Q1", "Q5", "Q9", "A1", "A2"], isolated=False).write.mode("overwrite").parquet(f"{where}/reports/batch={number}")

    for n in range(2):
        rows.filter(F.col("p_id") % 2 == n).write.parquet(f"{where}/in/part={n}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{where}/in/part=*")
        T.run_upserts(stream.select(*rows.columns), merged, "seq", ("p_id", "seq"), f"{where}/checkpoint", after=report)
    return spark.read.schema("question string, answer string, error string").parquet(f"{where}/reports/batch=1")


EARLY = "p_id <= 2000 AND p_id % 2 = 0"
LEDGER_SQL = f"WITH everyone AS ({A.VIEW}), applicants AS (SELECT * FROM everyone WHERE ({EARLY}) OR p_id > (SELECT max(p_id) FROM everyone WHERE {EARLY})) "


def _ledger(spark, sf_dir) -> tuple[KeyedTable, str]:
    """Two loads and a report after each; among them a malformed message, an unknown kind, loads without a path, of a path that does not exist and
    with a mark that is no number, and a repeated load."""
    where, rows = shared_folder(spark), A.applicants(spark, sf_dir)
    rows.filter(EARLY).write.parquet(f"{where}/feed/0")
    rows.write.parquet(f"{where}/feed/1")
    results = KeyedTable(spark, f"{where}/table", rows.schema, "p_id", 16)
    read = spark.read.schema(rows.schema).parquet
    handlers = {"scrape_new_data": T.incremental_loads(results, read, "seed", "date_added"), "recompute_analytics": recomputing(results, f"{where}/reports")}
    load, first, second = "scrape_new_data", {"path": f"{where}/feed/0"}, {"path": f"{where}/feed/1"}
    sent = [(load, first), ("recompute_analytics", {}), (load, {}), (load, {"path": f"{where}/none"}), (load, second | {"since": "abc"}), ("drop_everything", second), (load, second), (load, second), ("recompute_analytics", {})]
    bodies = [json.dumps({"kind": k, "ts": f"2026-01-01T00:00:{n:02d}", "payload": p}) for n, (k, p) in enumerate(sent)] + ["not-json{{", "[1, 2]"]
    write_messages(spark.createDataFrame([(b,) for b in bodies], "value string").coalesce(1), f"{where}/in")
    T.run_messages(message_stream(spark, f"{where}/in", 10), results, handlers, f"{where}/quarantine", f"{where}/checkpoint")
    return results, where


@query(LEDGER_SQL + "SELECT p_id, url, status, gpa FROM applicants")
def stream_ledger(spark, sf_dir):
    """What messages have loaded: rows and marks of a message appear in one record, those of a failed one not at all."""
    return _ledger(spark, sf_dir)[0].read().select("p_id", "url", "status", "gpa")


@query(LEDGER_SQL + ANSWERS_SQL + OTHER_ANSWERS_SQL + A3_LINES_SQL)
def report_recomputed(spark, sf_dir):
    """The report that the last message asked for, made of the buckets' partial sums."""
    reports = spark.read.parquet(f"{_ledger(spark, sf_dir)[1]}/reports")
    return reports.filter(F.col("step") == reports.agg(F.max("step")).first()[0]).select("question", "answer", "error")


@query("SELECT p_id, url FROM applicants WHERE p_id % 3 = 0 AND p_id % 2 = 0", True)
def merge_refused(spark, sf_dir):
    """The rows that refuse a merge: their ids are stored under other urls."""
    rows = A.applicants(spark, sf_dir)
    results = results_table(spark, shared_folder(spark), 16)
    results.merge(rows.filter("p_id % 2 = 0").withColumn("url", F.concat("url", F.lit("/old"))))
    try:
        results.merge(rows.filter("p_id % 3 = 0"))
    except Violates as e:
        return e.rows.select("p_id", "url")
    raise AssertionError("a row's id is stored under another url, and the merge went through")


@query(A3_SQL, True)
def a3_indexed(spark, sf_dir):
    """The school search over a stored table, by its index of trigrams."""
    results = results_table(spark, shared_folder(spark), 16)
    results.merge(A.applicants(spark, sf_dir))
    return school_search(results)
