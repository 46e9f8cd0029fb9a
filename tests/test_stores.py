"""Stores after lost versions, reports with failing questions, links, fuzzy look-ups and loads against plain models."""

import os
import shutil
from difflib import get_close_matches
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from rillflow.operators import html_rows as H
from rillflow.operators import names as M
from rillflow.plans import applicants as A
from rillflow.sources import results as S
from rillflow.sources import store

SF = "/root/testdata/sf0.001"


def version(folder):
    """Folder of the newest version."""
    return max((p for p in os.listdir(folder) if p.startswith("v-")), key=lambda p: os.path.getmtime(f"{folder}/{p}"))


@pytest.mark.parametrize("fault", ["missing", "corrupt", "empty"])
def test_a_lost_version_counts_as_none_and_is_replaced(spark, tmp_path, fault):
    where = f"{tmp_path}/t"
    store.publish(spark.range(10), where)
    store.publish(spark.range(20), where)
    lost = f"{where}/{version(where)}"
    for f in os.listdir(lost):
        os.remove(f"{lost}/{f}")
    if fault == "missing":
        shutil.rmtree(lost)
    elif fault == "corrupt":
        with open(f"{lost}/part-0.parquet", "wb") as f:
            f.write(b"no parquet at all")
    assert store.current(spark, where) is None
    assert store.publish(spark.range(5), where) == 5  # nothing readable to shrink
    assert store.current(spark, where).count() == 5
    with pytest.raises(store.Shrinks):
        store.publish(spark.range(4), where)
    assert store.current(spark, where).count() == 5
    assert store.current(spark, f"{tmp_path}/none") is None


def test_default_questions_are_isolated(spark):
    df = A.applicants(spark, SF)
    df = df.withColumn("gpa", F.when(F.col("p_id") > 0, F.raise_error(F.lit("bad column"))).cast("double"))
    got = {r["question"]: r for r in A.report(df).collect()}
    assert list(got) == list(A.QUESTIONS)
    assert {q for q, r in got.items() if r["error"]} >= {"Q3", "Q4", "Q6"}
    assert got["Q1"]["answer"].startswith("Applicant count: ") and got["A1"]["error"] is None


def test_search_lines_keep_their_order(spark):
    df = A.applicants(spark, SF)
    rows = A.a3(df).collect()
    want = [" | ".join([*map(str, r[:4]), f"GPA: {'N/A' if r[4] is None else r[4]}"]) for r in rows]
    assert len(want) > 3 and want != sorted(want)
    assert A.report(df, ["A3"]).first()["answer"].split("\n") == want


def test_links_are_resolved_like_the_standard_library(spark):
    urls = ["https://example.org", "https://example.org/", "https://example.org/a/b?q=1#f", "https://example.org/a/b/", "http://example.org:80/x"]
    links = ["", "/", "/r/1?x=2#y", "?page=2", "#top", "c", "c/d?e", "./c", "../c", "../../c", "../../../c", ".", "..", "//other.org/z", "https://z.org/a/../b", "mailto:a@b.c", "a/./b/../c", "/a/../b/."]
    df = spark.createDataFrame([(u, x) for u in urls for x in links], "url string, link string")
    for r in df.withColumn("full", H.absolute(F.col("link"), F.col("url"))).collect():
        assert r["full"] == urljoin(r["url"], r["link"]), (r["url"], r["link"])


def test_missing_and_malformed_files_are_reported(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"program": "a"}, {"program": ')
    (tmp_path / "good.json").write_text('[{"program": "a"}, {"program": "b"}]')
    rows, error = S.load_array(spark, f"{tmp_path}/good.json")
    assert error is None and rows.count() == 2
    for name in ("bad.json", "none.json"):
        rows, error = S.load_array(spark, f"{tmp_path}/{name}")
        assert error and rows.count() == 0 and rows.columns == S.RAW.names


def test_reference_lists_keep_the_order_of_lines(spark, tmp_path):
    names = [f"name {k * 7919 % 1000}" for k in range(500)]
    (tmp_path / "a.txt").write_text("\r\n".join(names[:250]) + "\n\n")
    (tmp_path / "b.txt").write_text("\n".join(f"  {n}" for n in names[250:]))
    assert [r["name"] for r in S.read_names(spark, str(tmp_path)).orderBy("line").collect()] == names
    assert S.read_names(spark, f"{tmp_path}/none.txt").count() == 0


@pytest.mark.parametrize("cutoff", [0.6, 0.84, 0.95])
def test_fuzzy_matches_equal_a_full_search(spark, cutoff):
    letters = "aabcdee fgio"
    words = ["".join(letters[(k * k + 3 * i * k + i) % 12] for i in range(3 + k % 14)).strip() or "x" for k in range(160)]
    canon = M.lookup_map(spark.createDataFrame([(w, k) for k, w in enumerate(words[:80])], "name string, line long"))
    names = [w[::-1][1:] + "a" for w in words[40:90]] + [w + "e" for w in words[:60]] + ["", "zz"]
    got = {r["name"]: r["canonical"] for r in M.fuzzy_matches(spark.createDataFrame([(n,) for n in names], "name string"), canon, cutoff).collect()}
    held = [r["k"] for r in canon.collect()]
    want = {n: m[0] for n in set(names) if n and (m := get_close_matches(n.lower(), held, 1, cutoff))}
    assert {n: c.lower() for n, c in got.items()} == want
