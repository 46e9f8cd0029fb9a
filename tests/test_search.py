"""The trigram index: equal to a scan for every text, and only candidate files are read."""

import pytest

from rillflow.plans import applicants as A
from rillflow.plans import search as X
from rillflow.sources.keyed import KeyedTable


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = A.applicants(spark, "/root/testdata/sf0.001").filter("status like 'Accepted%'")
    rare = rows.limit(3).selectExpr(*[{"p_id": "p_id + 900000 as p_id", "program": "concat('Art, Zürich 100%_\\\\\\\\ Polytechnic ', p_id) as program", "url": "concat(url, '/z') as url", "term": "'Fall 2026' as term"}.get(c, c) for c in rows.columns])
    t = KeyedTable(spark, f"{tmp_path_factory.mktemp('s')}/t", rows.schema, "url", 32)
    t.merge(rows)
    t.merge(rare)
    return t


@pytest.mark.parametrize("text", [None, "southern cal", "SOUTHERN California", "mit", "it", "%", "100%", "_", "zürich 100%_\\ POLY", "polytechnic 1", "no such place", "Art, Z"])
def test_equal_to_a_scan(table, text):
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(X.a3_indexed(table, text)) == rows(A.a3(table.read(), text))


def test_only_candidate_files_are_read(table):
    every, some = table.read().inputFiles(), X.candidates(table, "Zürich")
    assert 1 <= len(some) <= 3 and X.candidates(table, "no such place") == []
    read = table.read(buckets=some).inputFiles()
    assert 1 <= len(read) <= 3 < len(every) and set(read) < set(every)
    assert len(X.candidates(table, "mi")) == len(table.version().folders["rows"])  # a short text: the scan
    assert len(X.a3_indexed(table, "no such place").inputFiles()) == 0
