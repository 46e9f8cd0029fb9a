import json

import pytest
from pyspark.sql import functions as F

from rillflow.operators.merge import newest_by_key, resume
from rillflow.sources import results as R
from rillflow.sources import store as S
from rillflow.sources.tasks import message
from rillflow.streaming import tasks as T

ROW = {"program": "a, b", "url": "u", "status": "x"}


def put(path, text):
    path.write_text(text)
    return str(path)


def test_readers(spark, tmp_path):
    array = put(tmp_path / "a.json", json.dumps([ROW, ROW | {"url": "v", "Degree": "no"}]))
    assert R.read_array(spark, array).count() == 2
    assert R.read_array(spark, array).filter("degree is not null").count() == 0
    with pytest.raises(Exception):
        R.read_array(spark, put(tmp_path / "bad.json", "[{")).collect()
    lines = put(tmp_path / "a.jsonl", json.dumps(ROW) + "\n\n" + json.dumps(ROW) + "\n")
    assert R.read_lines(spark, lines).count() == 2
    assert R.read_rows(spark, array).count() == 2
    assert R.read_rows(spark, put(tmp_path / "r.json", json.dumps({"rows": [ROW]}))).count() == 1
    assert R.read_rows(spark, put(tmp_path / "s.json", "3")).count() == 0
    R.convert(spark, lines, str(tmp_path / "p"))
    R.append(R.read_lines(spark, lines), str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    assert df.count() == 4 and R.known_urls(df).count() == 1 and R.by_key(df, "url", "u").count() == 1


def test_names(spark, tmp_path):
    names = R.read_names(spark, put(tmp_path / "n.txt", " McGill \n\nmcgill\nX\n"))
    from rillflow.operators.names import lookup_map

    assert {r["k"]: r["canonical"] for r in lookup_map(names).collect()} == {"mcgill": "mcgill", "x": "X"}


def test_publish_refuses_to_shrink(spark, tmp_path):
    path = str(tmp_path / "t")
    assert S.current(spark, path) is None
    assert S.publish(spark.range(3), path) == 3
    with pytest.raises(S.Shrinks):
        S.publish(spark.range(2), path)
    assert S.publish(spark.range(5), path) == 5
    assert S.current(spark, path).count() == 5


def test_resume_and_precedence(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "url string, v int")
    assert {r["v"] for r in resume(df, df.filter("url = 'a'"), "url").collect()} == {2, 3}
    got = newest_by_key("url", df, spark.createDataFrame([("a", 9)], "url string, v int"))
    assert {r["url"]: r["v"] for r in got.collect()} == {"a": 9, "b": 2}


def test_tasks(spark, tmp_path):
    bodies = ['{"kind":"good","payload":{"since":"5"}}', "not-json{{", "[1]", "7", '{"kind":"unknown"}', '{"kind":"fails"}']
    src = str(tmp_path / "in")
    spark.createDataFrame([(b,) for b in bodies], "value string").coalesce(1).write.text(src)
    done = []

    def fails(df, n):
        raise RuntimeError

    stream = spark.readStream.schema("value string").text(src)
    T.run_tasks(stream, {"good": lambda df, n: done.extend(df.collect()), "fails": fails}, str(tmp_path / "q"), str(tmp_path / "c"))
    assert [(r["kind"], r["payload"]) for r in done] == [("good", {"since": "5"})]
    reasons = spark.read.parquet(str(tmp_path / "q")).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in reasons} == {"malformed": 3, "unknown kind": 1, "failed: RuntimeError": 1}
    text = spark.range(1).select(message(F.lit("k"), F.lit("t")).alias("m")).first()["m"]
    assert json.loads(text) == {"kind": "k", "ts": "t", "payload": {}}
