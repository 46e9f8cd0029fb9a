import numpy as np
import pytest
from helpers import LONG, ODD, exact, frame, rows, simhash, suffixes
from pyspark.sql import functions as F

from rillflow.llm import simhash as S
from rillflow.llm import suffix_dedup as X
from rillflow.llm.common import connected_components, part_edges, part_of
from rillflow.llm.exact_dedup import exact_dedup, exact_groups

DOCS = [(10 * k, f"document {k // 3} tells of {k // 3 * 7} things and of {k % 3 if k % 4 == 0 else 0} more, while others repeat the words that were said before it. " * (1 + k % 2)) for k in range(30)]


def digest():
    return {"text_sha256": F.sha2(F.encode("__norm", "UTF-8"), 256)}


def test_exact_groups(spark):
    docs = ODD + DOCS + [(900, DOCS[0][1].replace(" ", "\n "))]
    assert rows(exact_groups(frame(spark, docs), carry=digest())) == exact(docs)
    assert exact_groups(frame(spark, [])).count() == 0


def test_exact_without_broadcast(spark):
    from rillflow.llm.exact_dedup import refined

    df = frame(spark, ODD)
    assert refined(df, broadcast_keys=0).filter("__full is not null").count() == refined(df).filter("__full is not null").count() == 7


def test_exact_dedup_keeps_one_of_each(spark):
    kept = exact_dedup(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 3, 4, 6, 7, 8]


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_position_sets_cover(size):
    from itertools import combinations

    sets = S.position_sets(size)
    assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_simhash_classes(spark):
    docs = ODD + DOCS
    got = S.simhash_classes(frame(spark, docs)).select("doc_id", "fingerprint", "component_id")
    assert rows(got) == simhash(docs)
    assert S.simhash_classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n, tile, lists", [(300, 8192, 9), (300, 7, 9999), (300, 7, 0), (10**7, 8192, 9), (10**10, 8192, 9)])
def test_links_are_complete(spark, n, tile, lists):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), False)) for b in base for _ in range(5)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in flips})
    e = S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), n, tile=tile, broadcast_lists=lists)
    got = {r["node"]: r["root"] for r in connected_components(e).collect()}
    label = {f: f for f in fps}
    for _ in range(len(fps)):
        before = dict(label)
        for a in fps:
            for b in fps:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert {f: got.get(f, f) for f in fps} == label


CLASHING = ["__norm", "__len", "__prefix", "__again", "__full", "__keep", "__hash", "__row", "__id", "__key", "__gone", "__first", "__own", "__held", "key", "id", "root", "h", "y"]


def test_filters_keep_columns_of_any_name(spark):
    """What the pipeline's stages keep comes out as it went in."""
    from rillflow.llm.decontaminate import clean_rows
    from rillflow.llm.near_copies import near_copies
    from rillflow.llm.toxicity import fit, keep_clean

    docs = [(1, "one text of some words here", 1), (2, "one text of some words here", 2), (3, None, 3), (None, "alone " * 9, 4), (5, "what is the capital city of this land", 5)]
    wide = spark.createDataFrame([(i, t, *[f"{c}{n}" for c in CLASHING]) for i, t, n in docs], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))
    items = spark.createDataFrame([(1, "what is the capital city of this land")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for kept, want in ((exact_dedup(wide), [1, 3, 4, 5]), (near_copies(wide), [1, 3, 4, 5]), (clean_rows(wide, items), [1, 2, 3, 4]), (keep_clean(wide, fit(wide, labels)), [1, 2, 3, 4, 5])):
        assert kept.columns == wide.columns
        got = {r["__norm"]: r for r in kept.collect()}
        assert sorted(got) == [f"__norm{n}" for n in want]
        assert all(r[c] == f"{c}{name[6:]}" for name, r in got.items() for c in CLASHING)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["root"] for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


def test_near_dedup_keeps_one_of_each(spark):
    docs = [(i, t) for i, t in ODD + DOCS if i is not None]
    kept = S.near_dedup(frame(spark, docs))
    assert kept.columns == frame(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in simhash(docs)})


SUFFIX = [(20, "a" * 200), (21, "b" + "a" * 90), (22, "ab" * 60), (23, "b" + "ab" * 50), (24, "y" * 49), (25, "\0" * 80), (26, "q" + "\0" * 60), (3, "intro " + DOCS[5][1])]


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, monkeypatch, small):
    docs = [(i, t if t is not LONG else t[:3000]) for i, t in ODD] + DOCS + SUFFIX
    sizes = {}
    if small:  # many batches, buckets, levels and hot hashes
        monkeypatch.setattr(X, "HEAVY", 2)
        monkeypatch.setattr(X, "BATCH_WINDOWS", 200)
        sizes = {"part_bytes": 1500, "bucket_hashes": 300}
    got = X.suffix_dedup(frame(spark, docs), with_text=True, **sizes)
    assert rows(got.drop("kept")) == suffixes(docs)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got.collect())
    assert X.suffix_dedup(frame(spark, [])).count() == 0


def test_suffix_dedup_with_hot_ids(spark):
    """Ids that fill several parts, and null ids that fill as many more."""
    rng = np.random.default_rng(4)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 14))
    shared = [line() for _ in range(6)]
    docs = [(i, f"{line()} {shared[k % 6]} {line()} {shared[(k + i) % 6]}") for k in range(12) for i in (7, 7, 7, 9, 3)] + [(None, shared[k % 6] + line()) for k in range(40)]
    docs += [(k + 20, shared[k % 6]) for k in range(12)]
    edges = part_edges(frame(spark, docs), "doc_id", sum(len(t) for _, t in docs), 700)
    assert len(edges) > len(set(edges)) > 2
    placed = frame(spark, docs).select("doc_id", part_of("doc_id", "text", edges, len(edges) + 1).alias("part")).distinct().collect()
    assert len({r["part"] for r in placed if r["doc_id"] == 7}) > 3 < len({r["part"] for r in placed if r["doc_id"] is None})
    for small, large in ((3, 7), (7, 9), (9, 20)):  # parts follow the ids, but that neighbours may share one
        assert max(r["part"] for r in placed if r["doc_id"] == small) <= min(r["part"] for r in placed if r["doc_id"] == large)
    assert rows(X.suffix_dedup(frame(spark, docs), part_bytes=700, bucket_hashes=200)) == suffixes(docs)


def test_parts_of_many_edges(spark):
    docs = [(k // 2 if k % 9 else 40, f"text {k}") for k in range(3000)] + [(None, f"t{k}") for k in range(50)]
    df = frame(spark, docs)
    edges = sorted([k // 2 for k in range(0, 2400, 2)] + [40] * 30)
    many = {(r["doc_id"], r["text"]): r["part"] for r in df.select("doc_id", "text", part_of("doc_id", "text", edges, len(edges) + 1).alias("part")).collect()}
    for (i, _), p in many.items():
        if i is None:
            assert len(edges) < p <= 2 * len(edges) + 1
        else:
            assert (p == len(edges) or i <= edges[p]) and (p == 0 or edges[p - 1] <= i)
    assert len({p for (i, _), p in many.items() if i == 40}) > 20


def test_family_levels_stay_few():
    family, rng, held = X.Family(), np.random.default_rng(1), {}
    for n in range(40):
        keys = np.unique(rng.integers(97, 123, (30, 2), dtype=np.uint8).view("S2")[:, 0])
        owner = np.full(len(keys), n // 3)
        assert family.scan(keys, owner).tolist() == [held.get(k, n // 3) for k in keys.tolist()]
        family.add(keys, owner)
        held = {k: n // 3 for k in keys.tolist()} | held
    assert len(family.levels) <= 8 and set(np.concatenate([k for k, _ in family.levels]).tolist()) == set(held)


def test_suffix_array_sorts_windows():
    text = np.frombuffer(b"abracadabra" * 30 + b"x" * 80, np.uint8)
    starts = np.arange(len(text) - X.SPAN + 1)
    order, same = X.suffix_array(text, starts)
    w = [text[s : s + X.SPAN].tobytes() for s in starts[order]]
    assert w == sorted(w) and same.tolist() == [False] + [a == b for a, b in zip(w, w[1:])]


def test_a_million_edges_take_a_second(spark):
    import time

    edges = [k // 2 for k in range(1_000_000)]
    began = time.time()
    part_of("doc_id", "text", edges, 3)
    assert time.time() - began < 2


def test_a_minimizer_of_very_many_batches_is_hot():
    """Each of 600 batches has it once: none would call it hot, the bucket does."""
    import pyarrow as pa

    from rillflow.llm import suffix_dedup as S

    value = lambda *keys: b"".join((k << 2).to_bytes(6, "little") for k in keys)
    told = pa.table({"bucket": pa.array([3] * 600, pa.int32()), "part": pa.array(range(600), pa.int32()), "hashes": [value(7, 100 + k, 9000) if k < 2 else value(7, 100 + k) for k in range(600)]})
    got = {r["part"]: S._unpack(r["hashes"]).tolist() for r in S._answer(told).to_pylist()}
    assert len(got) == 600 and got[0] == [(7 << 2) | 1, 9000 << 2] and got[499] == [(7 << 2) | 1]
