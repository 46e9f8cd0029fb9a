import pytest
from pyspark.sql import functions as F

from rillflow.functions import numbers as N
from rillflow.functions import text as X
from rillflow.plans import applicants as A


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("Added on Sep 12, 2026", "2026-09-12"), ("Sep 3, 2026", "2026-09-03"), ("Added on Sep  3, 2026", "2026-09-03"), ("sep 03, 2026", "2026-09-03"), ("March 31, 2026", None), ("Sep 31, 2026", None), ("", None), (None, None)],
)
def test_added_date(spark, text, want):
    got = one(spark, X.added_date("t"), t=text)
    assert (got and str(got)) == want


@pytest.mark.parametrize("text, ranges, want", [(None, [(0, 4)], None), ("", [(0, 4)], None), ("no digits here", [(0, 4)], None), ("GPA 3.50", [(0, 4)], 3.5), ("GRE 99", [(130, 170)], None), ("GPA 3.4.0", [(0, 4)], None), ("x 5", [(0, 1), (5, 6)], 5.0)])
def test_first_number(spark, text, ranges, want):
    assert one(spark, X.first_number("t", ranges), t=text) == want


@pytest.mark.parametrize("url, want", [("https://a.b/result/12", 12), ("/result/7/x", 7), ("https://a.b/none", None), ("/result/99999999999", None), (None, None)])
def test_id_after(spark, url, want):
    assert one(spark, X.id_after("t"), t=url) == want


@pytest.mark.parametrize("text", ["McGill-Queen O'brien", "of THE x1y2z", "éCOLE d'été", "", "a  b\tc", "ÅNGSTRÖM-ßtraße"[:8]])
def test_title_case(spark, text):
    assert one(spark, X.title_case("t"), t=text) == text.title()


@pytest.mark.parametrize("text, pattern, want", [("100% x", "0%", True), ("1000 x", "0%", False), ("a_b", "_", True), ("ab", "_", False), ("a\\b", "\\", True), ("AB", "b", True)])
def test_contains_is_literal(spark, text, pattern, want):
    assert one(spark, X.contains_ci("t", pattern), t=text) is want


@pytest.mark.parametrize("term, valid, year", [("Fall 2026", True, 2026), ("fall 2026", True, 2026), ("Fall", False, None), ("2026", False, 2026), ("Fall2026", False, 2026), ("Autumn 2026", False, 2026), ("Fall 2026\n", False, None), (None, None, None)])
def test_terms(spark, term, valid, year):
    assert one(spark, X.matches_ci("t", A.VALID_TERM), t=term) is valid
    assert one(spark, X.trailing_year("t"), t=term) == year


def test_last_segment_takes_the_last_separator(spark):
    assert one(spark, X.last_segment("t"), t="Physics, University of California, Berkeley") == "Berkeley"


@pytest.mark.parametrize("value, want", [(2.345, "2.35"), (2.0, "2.00"), (None, "N/A")])
def test_text2(spark, value, want):
    assert spark.range(1).select(N.text2(N.round2(F.lit(value).cast("double"))).alias("x")).first()["x"] == want


def test_percent_of_nothing_is_null(spark):
    assert spark.range(0).agg(N.percent_where(F.col("id") > 0).alias("x")).first()["x"] is None
    assert spark.range(4).agg(N.percent_text(N.percent_where(F.col("id") > 1)).alias("x")).first()["x"] == "50.00%"


def test_search_text_and_limits():
    assert A.search_text("  a   b ") == "a b"
    assert A.search_text(" ") == A.SCHOOL
    for bad in ("x" * 101, "a\x00b"):
        with pytest.raises(A.InvalidSchool):
            A.search_text(bad)
    assert [A.row_limit(x) for x in (None, "x", 0, 7, 1000)] == [50, 50, 1, 7, 100]
