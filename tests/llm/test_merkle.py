"""The Merkle manifest against a plain tree; folding against hashing everything anew."""

import zlib
from hashlib import sha256

import pytest
from helpers import rows
from pyspark.sql import functions as F

from rillflow.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, at long, path string, leaf string"


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf(row, low=False):
    i, text, lang, source, n = row[:5]
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def plain(table):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row."""
    langs = sorted({r[2] for r in table}, key=lambda x: (x is not None, (x or "").encode()))
    held = {x: sorted((r for r in table if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in held[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for p, r in enumerate(held[x]):
            d, others = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0), []
            for levels, at in ((trees[x], p), (top, k)):
                for level in levels[:-1]:
                    at, slot = divmod(at, 8)
                    run = level[8 * at : 8 * at + 8]
                    others += run[:slot] + run[slot + 1 :]
                    d = h(*run[:slot], d, *run[slot + 1 :])
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], h(*others), d, d == top[-1][0]))
    return sorted(out, key=str)


def proved(spark, table, depth):
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in table], SCHEMA)
    return M.proofs(M.manifest(docs, claim=M.lowered(F.crc32(F.col("doc_id").cast("string")) % 3 == 0), depth=depth))


ODD = [(1, None, "en", "s", 3), (2, "", None, None, None), (3, "Ab é " * 60_000, "en", "", 0), (3, "same", "en", "s", 1), (3, "same", "en", "s", 1), (None, "No id", "en", None, 2), (None, None, None, None, None), (-7, "A", "", "s", 1), (6, "Z", "é", "日本", 9)]


@pytest.mark.parametrize("n, depth", [(1, 4), (9, 1), (700, 1), (700, 4)])
def test_one_hot_group(spark, n, depth):
    table = [(k, f"Text {k}", "en" if k % 9 else f"l{k % 4}", f"s{k % 3}", k) for k in range(n)]
    assert rows(proved(spark, table, depth)) == plain(table)


def test_odd_rows(spark):
    assert rows(proved(spark, ODD, 1)) == plain(ODD)
    assert rows(proved(spark, [], 4)) == []


def test_many_groups(spark):
    table = [(k, f"T{k}", f"lang {k}", "s", k) for k in range(90)]
    assert rows(proved(spark, table, 1)) == plain(table)
    assert M.manifest(spark.createDataFrame([], SCHEMA)).root is None


def test_a_fold_resumes_the_state_and_leaves_left_siblings_alone():
    run = [h(str(k)).encode() for k in range(8)]
    parent = M.Parent(run)
    for slot in range(8):
        assert parent.folded(slot, run[slot]) == parent.digest
        changed = h("new").encode()
        assert parent.folded(slot, changed).decode() == sha256(b"".join([*run[:slot], changed, *run[slot + 1 :]])).hexdigest()
        other = M.Parent.__new__(M.Parent)
        other.states, other.run = parent.states, b"?" * 64 * slot + parent.run[64 * slot :]  # what lies left is not read
        assert other.folded(slot, changed) == parent.folded(slot, changed)
