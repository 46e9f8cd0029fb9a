"""Keyed tables: touched buckets, constraints, races, marks and sweeps; and racing publications of versioned tables."""

import threading

import pytest
from pyspark.sql import types as T

from rillflow.sources import store
from rillflow.sources.keyed import ROWS, KeyedTable, Violates

SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("p_id", T.IntegerType()), T.StructField("v", T.StringType())])


def table(spark, tmp_path, **more):
    return KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "url", 16, not_null=("v",), unique=("p_id",), **more)


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(t):
    return sorted(tuple(r) for r in t.read().collect())


def test_a_merge_rewrites_the_touched_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    first = t.merge(frame(spark, *[(f"u{k}", k, "a") for k in range(200)]))
    assert (first.inserted, first.updated, len(first.touched), first.version.rows) == (200, 0, 16, 200)
    got = t.merge(frame(spark, ("u7", None, "b")))
    assert (got.inserted, got.updated, len(got.touched), got.version.rows) == (0, 1, 1, 200)
    changed = [b for b, f in got.version.folders[ROWS].items() if first.version.folders[ROWS][b] != f]
    assert changed == got.touched and got.version.folders["p_id"] == first.version.folders["p_id"]
    assert held(t) == sorted((f"u{k}", k, "b" if k == 7 else "a") for k in range(200))
    assert len(t.read(first.version).inputFiles()) > len(t.read(buckets=got.touched).inputFiles()) >= 1
    assert t.read(first.version).filter("v = 'b'").count() == 0  # an older version still reads as it was


def test_constraints_refuse_a_merge_and_leave_the_table(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(frame(spark, ("a", 1, "x"), ("b", 2, "x"), ("n", None, "x")))
    before = t.version()
    with pytest.raises(Violates) as e:
        t.merge(frame(spark, ("c", 3, "x"), ("d", 2, "y")))
    assert e.value.rule == "unique: p_id" and [tuple(r) for r in e.value.rows.select("url", "p_id").collect()] == [("d", 2)]
    with pytest.raises(Violates) as e:
        t.merge(frame(spark, ("c", 3, "x"), ("d", 3, "y")))
    assert e.value.rule == "unique: p_id" and e.value.rows.count() == 1
    with pytest.raises(Violates) as e:
        t.merge(frame(spark, ("e", 5, None)))
    assert e.value.rule == "not null: v" and [r["url"] for r in e.value.rows.collect()] == ["e"]
    assert t.version() == before and held(t) == [("a", 1, "x"), ("b", 2, "x"), ("n", None, "x")]
    t.merge(frame(spark, ("a", 9, "z"), ("m", None, "x")))  # a stored row keeps its unique value, nulls never clash
    assert held(t) == [("a", 1, "z"), ("b", 2, "x"), ("m", None, "x"), ("n", None, "x")]
    got = t.merge(frame(spark, ("p", 9, "x"), ("q", 1, "x"), ("r", 9, "y")).selectExpr("*", "ascii(url) as seq"), seq="seq")
    assert [r["url"] for r in got.conflicts.orderBy("url").collect()] == ["q", "r"] and got.inserted == 1


def test_racing_merges_lose_no_row(spark, tmp_path):
    t, errors = table(spark, tmp_path), []

    def writer(n):
        try:
            t.merge(frame(spark, (f"w{n}", n, "x")), marks={f"w{n}": 1})
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(n,)) for n in range(3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and held(t) == [(f"w{n}", n, "x") for n in range(3)]
    assert t.version().number == 2 and t.version().marks == {"w0": 1, "w1": 1, "w2": 1} and t.version().rows == 3


def test_a_claimed_number_is_taken(spark, tmp_path):
    where = f"{tmp_path}/t"
    assert store.claim(spark, where, 0, {"a": 1}) and not store.claim(spark, where, 0, {"a": 2})
    assert store.newest(spark, where) == (0, {"a": 1})


def test_marks_and_sweeps(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.version().number == -1 and held(t) == [] and t.sweep() == []
    for k in range(4):
        t.merge(frame(spark, ("a", 1, str(k))), marks=lambda held: {"n": held.marks.get("n", 0) + 1})
    t.mark({"other": 5})
    t.merge(frame(spark), marks={"empty": 1})
    assert t.version().marks == {"n": 4, "other": 5, "empty": 1} and held(t) == [("a", 1, "3")]
    assert len(t.sweep()) == 3 and held(t) == [("a", 1, "3")] and t.sweep() == []


def test_racing_publications(spark, tmp_path):
    where, done = f"{tmp_path}/p", []
    threads = [threading.Thread(target=lambda: done.append(store.publish(spark.range(5), where))) for _ in range(3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert done == [5, 5, 5] and store.newest(spark, where)[0] == 2
    assert len(store.sweep(spark, where, keep=1)) == 2 and store.current(spark, where).count() == 5
