"""The message ledger: poison, kinds, repeats and crashes; and reports from partial sums."""

import json
import os

import pytest
from pyspark.sql import types as T

from rillflow.plans import applicants as A
from rillflow.plans import report_state as R
from rillflow.sources.keyed import ROWS, KeyedTable
from rillflow.streaming import tasks as S

SCHEMA = T.StructType([T.StructField("p_id", T.LongType()), T.StructField("v", T.StringType())])
SF = "/root/testdata/sf0.001"


class Crash(BaseException):
    """What ends a process: no handler's failure."""


def setting(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "p_id", 4)
    for n, rows in enumerate(([(20, "a"), (30, "b"), (25, "c"), (25, "d")], [(5, "old"), (40, "new")])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/feed/{n}")
    return table, S.incremental_loads(table, spark.read.schema(SCHEMA).parquet, "feed", "v")


def send(tmp_path, *bodies):
    os.makedirs(tmp_path / "in", exist_ok=True)
    n = len(os.listdir(tmp_path / "in"))
    (tmp_path / "in" / f"{n}.txt").write_text("\n".join(b if isinstance(b, str) else json.dumps(b) for b in bodies))


def asks(ts, kind="scrape_new_data", **payload):
    return {"kind": kind, "ts": f"2026-01-01T00:00:{ts:02d}", "payload": payload}


def run(spark, tmp_path, table, handlers):
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in")
    S.run_messages(stream, table, handlers, f"{tmp_path}/q", f"{tmp_path}/c")


def held(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_poison_goes_to_quarantine_and_nothing_of_it_is_visible(spark, tmp_path):
    table, load = setting(spark, tmp_path)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet at all")
    first, second = f"{tmp_path}/feed/0", f"{tmp_path}/feed/1"
    send(tmp_path, asks(1, path=first), "not-json{{", asks(2), asks(3, path=second, since="abc"), asks(4, path=f"{tmp_path}/bad"), asks(5, "recompute_analytics", path=second))
    run(spark, tmp_path, table, {"scrape_new_data": load})
    assert held(table) == [(20, "a"), (25, "c"), (30, "b")]
    send(tmp_path, asks(6, path=second), asks(6, path=second))
    run(spark, tmp_path, table, {"scrape_new_data": load})
    assert held(table) == [(20, "a"), (25, "c"), (30, "b"), (40, "new")]  # 5 is below the mark
    assert table.version().marks["mark:feed"] == 40
    reasons = sorted(r["reason"].split(":")[0] for r in spark.read.schema("raw string, reason string").parquet(f"{tmp_path}/q").collect())
    assert reasons == ["failed", "failed", "failed", "malformed", "unknown kind"]
    send(tmp_path, asks(7, path=second, since="1"))
    run(spark, tmp_path, table, {"scrape_new_data": load})
    assert (5, "old") in held(table) and table.version().marks["mark:feed"] == 40  # an older mark never moves it back


@pytest.mark.parametrize("before", [True, False])
def test_a_crash_before_or_after_the_record(spark, tmp_path, before):
    table, load = setting(spark, tmp_path)
    calls = []

    def crashes(payload, marks):
        calls.append(marks["step"])
        if len(calls) > 1:
            return load(payload, marks)
        if not before:
            load(payload, marks)
        raise Crash

    batch = spark.createDataFrame([(json.dumps(asks(1, path=f"{tmp_path}/feed/0")),)], "value string")
    with pytest.raises(Crash):
        S.handle_messages(batch, 3, table, {"scrape_new_data": crashes}, f"{tmp_path}/q")
    assert len(held(table)) == (0 if before else 3) and ("mark:feed" in table.version().marks) != before
    S.handle_messages(batch, 3, table, {"scrape_new_data": crashes}, f"{tmp_path}/q")
    assert len(calls) == (2 if before else 1)  # what is in the record is not handled again
    assert held(table) == [(20, "a"), (25, "c"), (30, "b")] and table.version().marks == {"step": 3 * S.MOST_MESSAGES, "mark:feed": 30}


def test_reports_scan_the_changed_buckets_only(spark, tmp_path):
    rows = A.applicants(spark, SF)
    table = KeyedTable(spark, f"{tmp_path}/t", rows.schema, "p_id", 8)
    assert [r["answer"] for r in R.report(table).collect()] == [r["answer"] for r in A.report(rows.limit(0)).collect()]
    table.merge(rows)
    want = [tuple(r) for r in A.report(rows).collect()]
    assert [tuple(r) for r in R.report(table).collect()] == want
    states = set(os.listdir(tmp_path / "t" / "state"))
    got = table.merge(rows.filter("p_id = 1").selectExpr(*[f"{'4.0D' if c == 'gpa' else c} as {c}" for c in rows.columns]))
    assert [tuple(r) for r in R.report(table).collect()] == [tuple(r) for r in A.report(table.read()).collect()]
    added = set(os.listdir(tmp_path / "t" / "state")) - states
    assert added == {got.version.folders[ROWS][b] for b in got.touched} and len(got.touched) == 1


def test_a_feed_in_pieces_goes_on_where_it_ended(spark, tmp_path):
    """Any cut into micro-batches, one of them handled twice, gives the totals and the stop page of the whole feed."""
    from rillflow.operators import feed as C
    from rillflow.streaming.feed import feed_batch, seen_urls

    rows = [(p, q, None if (p * 5 + q) % 13 == 0 else f"u{(p * 5 + q) * 7 % 31}") for p in range(18) for q in range(5)]
    feed = spark.createDataFrame(rows, "page_no long, pos int, url string")
    known = spark.createDataFrame([(f"u{k}", None) for k in range(0, 31, 3)], "url string, page_no long")
    per = C.pages(C.flagged_new(feed, known), known.count())
    want = sorted(tuple(r) for r in per.collect())
    stop = min(r[0] for r in want if r[3] >= 6)
    for name, cuts in (("a", (0, 7, 8, 18)), ("b", (0, 18)), ("c", (0, 12, 12, 18))):
        seen = seen_urls(spark, f"{tmp_path}/{name}", 4)
        seen.merge(known)
        for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            for _ in range(1 + (n == 1)):
                feed_batch(feed.filter(f"page_no >= {lo} and page_no < {hi}"), n, seen, f"{tmp_path}/{name}/pages", limit=6)
        got = spark.read.parquet(f"{tmp_path}/{name}/pages").select(*per.columns)
        assert sorted(tuple(r) for r in got.collect()) == want and seen.version().marks["stop"] == stop
        assert seen.version().rows == max(r[6] for r in want)
