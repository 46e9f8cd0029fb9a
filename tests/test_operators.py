"""Validation, merges, marks, names and pages on small fixtures and against plain models."""

from difflib import get_close_matches

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow.operators import feed as C
from rillflow.operators import html_rows as H
from rillflow.operators import merge as U
from rillflow.operators import names as M
from rillflow.operators import validate as V
from rillflow.operators import watermark as K
from rillflow.plans import applicants as A
from rillflow.schemas import MARKS, RAW, RESULTS

GOOD = {"program": "Computer Science, Test University", "date added": "Added on Sep 12, 2026", "url": "https://example.org/result/1", "status": "Accepted", "term": "Fall 2026", "US/International": "American", "degree": "Masters"}
SLOW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def raw(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f) for f in RAW.names) for r in rows], RAW)


def test_validation(spark):
    checked = V.converted(raw(spark, GOOD, GOOD | {"date added": "soon"}, GOOD | {"url": "https://example.org/x"}, GOOD | {"program": ""}, GOOD | {"url": None, "program": None}))
    assert V.valid_rows(checked).count() == 1
    got = {(r["reject_id"], tuple(r["missing"])) for r in V.rejects(checked).collect()}
    assert got == {("1", ("date_added",)), ("https://example.org/x", ("p_id",)), ("1", ("program",)), ("unknown url", ("program", "url"))}
    lenient = V.converted(raw(spark, GOOD | {"program": "", "date added": "seen on Sep  2, 2026", "US/International": "x"}), V.Rules(lenient=True)).first()
    assert (lenient["missing"], str(lenient["date_added"]), lenient["us_or_international"]) == ([], "2026-09-02", "x")


def test_row_columns(spark):
    assert V.valid_rows(V.converted(raw(spark, GOOD))).columns == RESULTS.names


def model_upsert(stored, incoming):
    """Rows one by one in order: (url, id, value) into a dict by url; an id that another url holds rejects the row."""
    table, rejected = {u: (i, v) for u, i, v in stored}, []
    for u, i, v in incoming:
        if u in table:
            old = table[u]
            table[u] = (old[0], old[1] if v is None else v)
        elif any(x == i for x, _ in table.values()):
            rejected.append(u)
        else:
            table[u] = (i, v)
    return table, rejected


ROW = st.tuples(st.integers(0, 6), st.one_of(st.none(), st.integers(0, 3)))


@SLOW
@given(st.lists(ROW, max_size=5), st.lists(ROW, max_size=9))
def test_merge_equals_one_by_one(spark, old, new):
    # The id is a function of the url (two urls share an id), as ids are cut out of urls.
    stored = list({u: (f"u{u}", u // 2, v) for u, v in old if u % 2 == 0}.values())
    incoming = [(f"u{u}", u // 2, v) for u, v in new]
    table, rejected = model_upsert(stored, incoming)
    o = spark.createDataFrame(stored, "url string, p_id int, v int")
    n = U.last_non_null(spark.createDataFrame([(*r, k) for k, r in enumerate(incoming)], "url string, p_id int, v int, seq int"), "url", "seq")
    bad = U.key_conflicts(o, n, "url", "p_id", "seq")
    merged = U.upsert(o, n.join(bad, "url", "left_anti").drop("seq"), "url", fixed=("p_id",))
    assert {r["url"]: (r["p_id"], r["v"]) for r in merged.collect()} == table
    assert {r["url"] for r in bad.collect()} == set(rejected)
    again = U.upsert(merged.drop("action"), n.join(bad, "url", "left_anti").drop("seq"), "url", fixed=("p_id",))
    assert sorted(map(tuple, again.drop("action").collect()), key=str) == sorted(map(tuple, merged.drop("action").collect()), key=str)


def test_incremental_marks(spark):
    empty, marks = spark.createDataFrame([], "p_id int, seq int"), spark.createDataFrame([], MARKS)
    feed = spark.createDataFrame([(20, 0), (30, 1), (25, 2)], "p_id int, seq int")
    rows, state = K.incremental(empty, feed, marks, "s", "p_id", "seq")
    assert rows.count() == 3 and state.select("last_seen").first()[0] == "30"
    rows, again = K.incremental(rows, feed, state, "s", "p_id", "seq")
    assert rows.count() == 0 and again.select("last_seen").first()[0] == "30"
    assert K.incremental(empty, spark.createDataFrame([(5, 0)], "p_id int, seq int"), marks, "s", "p_id", "seq", since=5)[0].count() == 0
    lower = K.incremental(empty, feed.filter("p_id = 20"), state, "s", "p_id", "seq", since=3)
    assert lower[0].count() == 1 and lower[1].select("last_seen").first()[0] == "30"


def model_feed(rows, stored):
    seen, out, streak, uniques = set(stored), [], 0, len(stored)
    for page in sorted({p for p, _, _ in rows}):
        own, n, new = [r for r in rows if r[0] == page], 0, 0
        urls = set()
        for _, _, u in sorted(own, key=lambda r: r[1]):
            is_new = u is None or u not in seen
            streak = 0 if is_new else streak + 1
            n, new = n + 1, new + is_new
            if is_new and u is not None:
                urls.add(u)
        seen |= urls
        uniques += len(urls)
        out.append((page, n, new, streak, uniques))
    return out


@SLOW
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=25), st.sets(st.integers(0, 9), max_size=6))
def test_feed_equals_one_by_one(spark, rows, stored):
    rows = [(p, k, None if u is None else f"u{u}") for k, (p, u) in enumerate(rows)]
    f = spark.createDataFrame(rows, "page_no int, pos int, url string")
    s = spark.createDataFrame([(f"u{u}",) for u in stored], "url string")
    got = C.pages(C.flagged_new(f, s), len(stored)).orderBy("page_no").collect()
    assert [(r["page_no"], r["n_read"], r["n_new"], r["streak"], r["unique_total"]) for r in got] == model_feed(rows, {f"u{u}" for u in stored})


@pytest.mark.parametrize("text, want", [("Computer Science, Test University", ("Computer Science", "Test University")), ("Math at UBC", ("Math", "Ubc")), ("Math @  UBC", ("Math", "Ubc")), ("just one part", ("Just One Part", "")), ("", ("", "")), (None, ("", "")), ("x, University Of Y, z", ("X", "University of Y"))])
def test_split(spark, text, want):
    p, u = M.split_name(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(p, u).first()) == want


def test_fuzzy_ratio_is_the_standard_librarys(spark):
    canon = ["McGill University", "University of Toronto", "Mathematics", "Applied Mathematics", "Physics", "Biophysics"]
    names = ["mcgil university", "Universty of Toronto", "Mathematic", "Phisics", "nothing like it", "bio physics"]
    c = spark.createDataFrame([(n.lower(), n) for n in canon], "k string, canonical string")
    got = {r["name"]: r["canonical"] for r in M.fuzzy_matches(spark.createDataFrame([(n,) for n in names], "name string"), c, 0.8).collect()}
    lower = {n.lower(): n for n in canon}
    want = {n: lower[m[0]] for n in names if (m := get_close_matches(n.lower(), list(lower), n=1, cutoff=0.8))}
    assert got == want and len(want) >= 4


def test_standardised_pipelines(spark):
    canon = spark.createDataFrame([(n.lower(), n) for n in ("McGill University", "University of British Columbia", "Mathematics")], "k string, canonical string")
    df = spark.createDataFrame([("mcg",), ("U.B.C.",), ("University Of British Columbia",), ("mcgil university",), ("unknown place",), (None,)], "u string")
    got = {r["u"]: r["standard"] for r in M.standardised(df, "u", canon, "university").collect()}
    assert got == {"mcg": "McGill University", "U.B.C.": "University of British Columbia", "University Of British Columbia": "University of British Columbia", "mcgil university": "McGill University", "unknown place": "Unknown Place", None: ""}
    assert M.standardised(spark.createDataFrame([("Mathematic",)], "p string"), "p", canon, "program").first()["standard"] == "Mathematics"


PAGE = """<table><tr class="x"><td>head</td></tr>
<tr><td><div>Test U</div></td><td><span>CS</span><span>PhD</span></td><td>Sep 12, 2026</td><td>Accepted on Sep 10</td><td><a href="/result/1">a</a></td></tr>
<tr class="tw-border-none"><td><div><div>Fall 2026</div><div>American</div><div>Accepted on Sep 10</div><div>GPA 3.75</div><div>GRE AW 4.5</div></div></td></tr>
<tr class="tw-border-none"><td><p>Nice &amp; quick</p></td></tr>
<tr><td>B U</td><td><span>Biology</span><span>MS</span></td><td>Sep 12, 2026</td><td>Rejected on Sep 11</td><td><a href="https://o.org/result/2">a</a></td></tr>
<tr class="tw-border-none"><td><div><div>Fall 2026</div><div>International</div></div></td></tr>
<tr><td>P U</td><td><span>Physics</span><span>Other</span></td><td>Sep 12, 2026</td><td>Interview</td><td></td></tr>
<tr class="other"><td>ends the group</td></tr><tr class="tw-border-none"><td><div>orphan</div></td></tr></table>"""


def test_result_pages(spark):
    df = spark.createDataFrame([(1, "https://example.org/list?x", PAGE), (2, "https://example.org", None)], "page_id int, url string, html string")
    got = [r.asDict() for r in H.records(df).orderBy("pos").collect()]
    assert [(r["program"], r["degree"], r["status"], r["n_details"]) for r in got] == [("CS, Test U", "PhD", "Accepted on Sep 10", 2), ("Biology, B U", "Masters", "Rejected on Sep 11", 1), ("Physics, P U", "Other", "Interview", 0)]
    assert (got[0]["gpa"], got[0]["gre_aw"], got[0]["comments"], got[0]["url"], got[0]["term"]) == ("GPA 3.75", "GRE AW 4.5", "Nice & quick", "https://example.org/result/1", "Fall 2026")
    assert got[1]["comments"] is None and got[1]["url"] == "https://o.org/result/2" and got[1]["gpa"] is None


def results(spark, *rows):
    base = {"p_id": 1, "status": "Accepted", "term": "Fall 2026", "degree": "Masters", "us_or_international": "American", "program": "CS, Test U"}
    return spark.createDataFrame([tuple((base | r).get(c) for c in RESULTS.names) for r in rows], RESULTS)


def test_search_fixture(spark):
    usc = "Computer Science, University of Southern California"
    df = results(spark, {"p_id": 1, "program": usc, "term": "Fall 2025"}, {"p_id": 2, "program": usc, "term": "Fall 2023"}, {"p_id": 3, "program": usc, "status": "Rejected"}, {"p_id": 4, "program": "Physics, Stanford University"}, {"p_id": 5, "program": "Art, 100% Online University"}, {"p_id": 6, "program": usc, "term": "Fall"})
    assert [r["term"] for r in A.a3(df).collect()] == ["Fall 2025"]
    assert [r["program"] for r in A.a3(df, "%").collect()] == ["Art, 100% Online University"]
    for text in ("_", "\\", "'; DROP TABLE x; --"):
        assert A.a3(df, text).count() == 0
    assert A.a3(results(spark, *[{"p_id": k, "program": usc} for k in range(60)])).count() == 50


def test_terms_fixture(spark):
    df = results(spark, *[{"p_id": k, "term": t} for k, t in enumerate(["Spring 2026", "Fall 2026", "fall 2026", "Fall", "2026", "Fall2026", "Autumn 2026"])])
    assert [(r["term"], str(r["pct_of_acceptances"])) for r in A.a1(df).collect()] == [("Spring 2026", "33.33"), ("Fall 2026", "33.33"), ("fall 2026", "33.33")]


def test_report_isolates_errors(spark):
    df = results(spark, {}, {"p_id": 2, "status": "Rejected"}, {"p_id": 3, "term": "Spring 2026"})
    every = {r["question"]: r["answer"] for r in A.report(df).collect()}
    assert list(every) == list(A.QUESTIONS) and every["Q1"] == "Applicant count: 2" and "N/A" in every["A2"] and every["A3"] == A.NONE_FOUND

    def broken(_):
        raise ValueError("no")

    got = {r["question"]: (r["answer"], r["error"]) for r in A.report(df, ["Q1", "Q7"], A.QUESTIONS | {"Q7": broken}).collect()}
    assert got == {"Q1": ("Applicant count: 2", None), "Q7": (None, "ValueError: no")}


def test_repairs_and_constraints(spark):
    df = spark.createDataFrame([(1, "a", 3.0, 150.0), (1, "b", 5.0, 99.0), (2, "b", None, None), (3, None, 0.0, 170.0)], "p_id int, url string, gpa double, gre double")
    assert V.out_of_range(df).first().asDict() == {"gpa": 1, "gre": 1}
    assert [r["gpa"] for r in V.repair_ranges(df).orderBy("p_id", "url").collect()] == [3.0, None, None, 0.0]
    assert {r["rule"]: r["violations"] for r in V.constraint_report(df, ["url"], ["p_id", "url"]).collect()} == {"not null: url": 1, "unique: p_id": 1, "unique: url": 1}
