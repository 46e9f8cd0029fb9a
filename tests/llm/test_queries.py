"""Registered corpus queries over the driver's smallest tables, and the pipeline against its parts."""

import hashlib
import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import SPACE, exact, near_classes, rows, simhash, suffixes

from rillflow.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs():
    return [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = c.execute(Q.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert rows(Q.QUERIES[name](spark, SF).select(*columns)) == sorted(want.fetchall(), key=str)


def test_against_brute_force(spark, docs):
    assert rows(Q.op1_suffix_array_dedup(spark, SF)) == suffixes(docs)
    assert rows(Q.op3_simhash_near_dedup(spark, SF)) == simhash(docs)
    assert rows(Q.op4_exact_dedup(spark, SF)) == exact(docs)


def test_round_trip(spark, docs):
    got = {r["doc_id"]: r["decoded_sha256"] for r in Q.op2_bpe_round_trip(spark, SF).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in docs}


def test_id_files_are_in_order(spark, docs):
    got = Q.op10_huffman_ids(spark, SF).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in docs)
    assert [r["start"] for r in got] == (np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1]).tolist()


@pytest.mark.parametrize("name, table", [("op5_toxicity", "documents"), ("op6_html_extraction", "pages"), ("op7_license_scan", "documents"), ("op9_context_tree_weighting", "documents")])
def test_one_row_each(spark, name, table):
    assert Q.QUERIES[name](spark, SF).count() == pq.read_metadata(f"{SF}/{table}.parquet").num_rows


def test_pipeline(spark, docs):
    import corpus_pipeline as P
    from rillflow.llm.bpe import ByteBPE

    df, text = spark.read.parquet(f"{SF}/documents.parquet"), dict(docs)
    left = [set(text)]
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        df = stage(spark, df, SF)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in df.select("doc_id").collect()})
        assert left[-1] <= left[-2]
    scores = {r["doc_id"]: r["score"] for r in Q.op5_toxicity(spark, SF).collect()}
    assert left[1] == {i for i, s in scores.items() if s < 0.3}
    first = {}
    for i in sorted(left[1]):
        first.setdefault(SPACE.sub(" ", text[i] or ""), i)
    assert left[2] == set(first.values())
    assert left[3] == set(near_classes([(i, text[i]) for i in sorted(left[2])]))
    flagged = {r["doc_id"] for r in Q.op8_benchmark_decontamination(spark, SF).collect()}
    assert left[4] == left[3] - flagged
    out = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    assert set(out) == left[4]
    bpe = ByteBPE(Q.vocabulary("byte_bpe_50k.json"))
    for i, ids in zip(sorted(out), bpe.encode([text[i] for i in sorted(out)])):
        assert bytes(out[i]["ids"]) == ids.tobytes() and out[i]["n_tokens"] == len(ids)
        assert out[i]["decoded_sha256"] == hashlib.sha256(text[i].encode()).hexdigest()
