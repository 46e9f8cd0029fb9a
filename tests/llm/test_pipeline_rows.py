"""run() on tables of odd rows: nulls, empty and long texts, ties, repeats, an empty table, extra columns with clashing names."""

import random

import pytest
from helpers import LONG, SPACE, near_classes
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row int, key string, __id long, sha string, kept boolean"


def write(spark, where, rows, labels, items):
    spark.createDataFrame([(*r, None, "s", 1, 2, "k", 3, "h", False) for r in rows], SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")


@pytest.fixture(scope="module")
def table():
    rng = random.Random(8)
    words, bad = [f"word{k}" for k in range(400)], [f"vile{k}" for k in range(25)]
    clean = [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(300)]
    toxic = [(k, " ".join(rng.choice(bad) for _ in range(40))) for k in range(300, 340)]
    return clean, toxic


def test_odd_rows(spark, tmp_path, table):
    import corpus_pipeline as P

    clean, toxic = table
    item = "what is the exact distance between the two old stations in whole miles"
    near = clean[5][1].replace(clean[5][1].split()[20], "other")
    odd = [(1000, None), (1001, ""), (1002, " \t"), (1003, LONG), (1004, LONG), (1004, LONG), (None, "a row without an id"), (None, "a row without an id"), (None, "another one"), (7, "shares its id with another row"), (1005, near), (None, near + " end"), (1006, f"so {item} then")]
    write(spark, tmp_path, clean + toxic + odd, [(i, 1, 0) for i, _ in clean] + [(i, 0, 1) for i, _ in toxic], [(1, item)])
    out = P.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    left, docs = {}, [*clean, *odd[:-1]]  # toxic rows go, and the one that holds the item
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        left.setdefault(SPACE.sub(" ", t or ""), (i, t))
    kept = [(i, t) for i, t in left.values()]
    named = {n: t for n, (_, t) in enumerate(kept)}  # near copies by place: ids may be null
    want = sorted(str(kept[n][0]) for n in near_classes(list(named.items())))
    assert sorted(str(r["doc_id"]) for r in out.collect()) == want
    texts = {t: i for i, t in kept}
    digests = {r["decoded_sha256"] for r in out.collect()}
    assert digests <= {r[0] for r in spark.createDataFrame([(t or "",) for t in texts], "t string").select(F.sha2(F.encode("t", "UTF-8"), 256)).collect()}


def test_empty_tables(spark, tmp_path, table):
    import corpus_pipeline as P

    write(spark, tmp_path / "a", [], [], [])
    assert P.run(spark, str(tmp_path / "a")).count() == 0
    write(spark, tmp_path / "b", table[0][:5], [], [])
    assert sorted(r["doc_id"] for r in P.run(spark, str(tmp_path / "b")).collect()) == [0, 1, 2, 3, 4]
