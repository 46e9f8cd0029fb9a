import numpy as np
from helpers import ODD, frame, near_classes, rows

from rillflow.llm import near_copies as N

RNG = np.random.default_rng(11)
VOCAB = ["".join(RNG.choice(list("abcdefghij"), 6)) for _ in range(900)]


def edited(words, n):
    w = list(words)
    for k in RNG.choice(len(w), n, False):
        w[k] = "edit" + str(RNG.integers(10**9))
    return " ".join(w)


def corpus():
    out, line = [], " ".join(RNG.choice(VOCAB, 30))
    for k in range(60):
        base = RNG.choice(VOCAB, int(RNG.integers(40, 400)))
        out += [(1000 * k, " ".join(base)), *((1000 * k + j, edited(base, int(RNG.integers(1, 2 + len(base) // 25)))) for j in range(1, 5))]
        out.append((1000 * k + 9, line + " " + " ".join(RNG.choice(VOCAB, 60))))
    return out


def test_recall_against_brute_force(spark):
    docs = corpus()
    want = near_classes(docs)
    assert 60 < len(want) < 300
    assert sorted(r["doc_id"] for r in N.near_copies(frame(spark, docs)).collect()) == want


def test_pipeline_stage(spark):
    import corpus_pipeline as P

    docs = corpus()
    assert sorted(r["doc_id"] for r in P.near(spark, frame(spark, docs), "").collect()) == near_classes(docs)


def test_tiles_lose_no_pair(spark):
    docs = corpus()[:90]
    df = frame(spark, docs)
    texts = N.signatures(df, "doc_id", "text", 5)
    groups = N.connected_components(N.candidates(texts, len(docs), tile=2)).withColumnRenamed("node", "key").join(texts.select("key", "sha"), "key")
    links = N.verified(df, groups, "text", 5, 0.8, tile=2)
    got = {r["node"]: r["root"] for r in N.connected_components(links).collect()}
    assert len(docs) - len(got) + len(set(got.values())) == len(near_classes(docs))


def test_rows_without_an_id_of_their_own(spark):
    a = " ".join(VOCAB[:100])
    near = a.replace(VOCAB[50], "other")
    docs = [(None, a), (None, near), (7, "x y z"), (7, near + " end"), (None, "kept by its text"), (None, "kept by its text"), (3, "X  y z")]
    kept = N.near_copies(frame(spark, docs))
    assert kept.columns == frame(spark).columns
    assert rows(kept.select("doc_id", "text")) == sorted([(3, "X  y z"), (7, near + " end"), (None, "kept by its text")], key=str)
    assert sorted(r["doc_id"] or 0 for r in N.near_copies(frame(spark)).collect()) == [1, 4, 6, 8] and len(ODD) == 10
    assert N.near_copies(frame(spark, [])).count() == 0


def test_fingerprints_are_simhash():
    for n in (1, 4, 90, 400):
        h = RNG.integers(0, 1 << 63, n, dtype=np.uint64)
        x = h[:, None] * N.TIMES + N.PLUS
        x = (x ^ (x >> np.uint64(29))) * N.MIX
        votes = np.unpackbits((x ^ (x >> np.uint64(32))).view(np.uint8).reshape(n * N.VOTES, N.BYTES), axis=1).astype(int).sum(0)
        assert (np.unpackbits(N.fingerprint(h)) == (2 * votes > n * N.VOTES)).all()


def test_texts_of_similarity_08_share_bytes():
    for n in (4, 8, 40, 400):
        for _ in range(100):
            h = RNG.integers(0, 1 << 63, n * 5 // 4, dtype=np.uint64)
            a, b = N.fingerprint(h), N.fingerprint(h[:n])
            assert (a.view(np.uint16) == b.view(np.uint16)).any()
            assert np.bitwise_count(a[: 8 * N.SKETCH] ^ b[: 8 * N.SKETCH]).sum() <= N.SKETCH_BITS


def test_long_lists_are_told(spark):
    docs = [(k, f"one text in many copies that differ by a word at its end and {k}") for k in range(40)]
    texts = N.signatures(frame(spark, docs), "doc_id", "text", 5)
    n = np.bincount(N.lists_of([r["fp"] for r in texts.select("fp").collect()]).ravel())
    told = {r["list"]: r["tiles"] for r in N.long_lists(texts, 8).collect()}
    assert set(np.flatnonzero(n > 8).tolist()) <= set(told) and all(8 * t >= n[k] for k, t in told.items())
