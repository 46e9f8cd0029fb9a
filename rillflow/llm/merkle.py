"""A Merkle manifest of a data set: hash trees over the rows of each group, and one over the groups' roots.

A leaf is the SHA-256 of a row's fields, made by built-in functions where the text lies; digests are hashed as lower-case hex text.
In a group the leaves ascend by id; on each level every `FAN` consecutive nodes, the last run fewer, become their hash, until one is left.
The groups' roots, ordered by group, give the root in the same way.

Only digests are shuffled: they are numbered by a range partitioning of (group, id), and chunks of FAN ** DEPTH consecutive leaves, which
are whole subtrees, are built by one task each; their tops are leaves of the next round, so there are about log(rows) / log(4096) rounds. A parent retains
a copy of the hash state before each child slot. To fold a changed leaf, the state before its slot is resumed with the new digest and
the right siblings only; left siblings are never hashed again.

Defined cases: a null field is `-`, any other its UTF-8 byte count, `:` and its value; null ids come first, rows with equal ids by their
leaves; repeated rows are leaves each; a null group is one of its own and comes first; empty texts are `0:`; an empty table has no rows and
no root; other columns, whatever their names, count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.common import counted, stored

#: Children of a node, and levels that one task builds.
FAN, DEPTH = 8, 4
#: Fields of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digests a task gets: this many, or more so that there are at most MOST_PARTS tasks.
PART_ROWS, MOST_PARTS = 1 << 15, 50_000

PATH = "array<struct<slot:int,run:binary>>"
_PATH = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.binary())]))


def leaf(fields: Sequence[Column]) -> Column:
    """Lower-case hex digest of a row's fields."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def levels(total: int) -> int:
    """Levels above the leaves of a tree over `total` leaves."""
    n = 0
    while total > 1:
        total, n = -(-total // FAN), n + 1
    return n


class Parent:
    """A run of digests: its hash, the state before each child slot, and what follows each slot."""

    __slots__ = ("run", "states", "digest")

    def __init__(self, run: Sequence[bytes]):
        h, self.run, self.states = sha256(), b"".join(run), []
        for d in run:
            self.states.append(h.copy())
            h.update(d)
        self.digest = h.hexdigest().encode()

    def folded(self, slot: int, digest: bytes) -> bytes:
        """The run's hash with another digest in a slot."""
        h = self.states[slot].copy()
        h.update(digest)
        h.update(self.run[64 * slot + 64 :])
        return h.hexdigest().encode()

    def others(self, slot: int) -> bytes:
        return self.run[: 64 * slot] + self.run[64 * slot + 64 :]


class Subtree:
    """The levels over consecutive digests; `top` is what is left after `n_levels` of them."""

    def __init__(self, digests: Sequence[bytes], n_levels: int):
        self.levels: list[list[Parent]] = []
        for _ in range(n_levels):
            self.levels.append([Parent(digests[i : i + FAN]) for i in range(0, len(digests), FAN)])
            digests = [p.digest for p in self.levels[-1]]
        (self.top,) = digests

    def path(self, at: int) -> list[tuple[int, Parent]]:
        out = []
        for level in self.levels:
            at, slot = divmod(at, FAN)
            out.append((slot, level[at]))
        return out


def folded(path: Iterable[tuple[int, Parent]], digest: bytes) -> bytes:
    """The digest at the end of a path if it starts from this one."""
    for slot, parent in path:
        digest = parent.folded(slot, digest)
    return digest


def _div(at: str, n: int) -> Column:
    return F.floor(F.col(at) / n).cast("long")


def _parts(n: int) -> int:
    return max(1, min(MOST_PARTS, -(-n // PART_ROWS)))


def numbered(nodes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Stored nodes (key, ...) plus at (place in the key's order, from 0) and total (nodes of the key); and their number.

    A range partitioning by key and order, so that a hot key is many tasks'; each task numbers its rows, and counts by task and key say
    where a task starts.
    """
    n, names = nodes.count(), nodes.columns
    row = F.col("_metadata.row_index").alias("row")
    ranged = nodes.select(*names, row).repartitionByRange(_parts(n), "key", *order, "row").sortWithinPartitions("key", *order, "row").select(*names)

    def place(batches):
        from pyspark import TaskContext

        part, key, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            places = []
            for k in b.column("key").to_pylist():
                at = at + 1 if k == key else 0
                key = k
                places.append(at)
            yield b.append_column("part", pa.array([part] * len(places), pa.int32())).append_column("place", pa.array(places, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields) + ", part int, place long"
    placed = stored(ranged.mapInArrow(place, schema))
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    by_key = W.partitionBy("key")
    starts = stored(counts.select("key", "part", (F.sum("n").over(by_key.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(by_key).alias("total")))
    return placed.join(counted(starts), ["key", "part"]).select(*names, (F.col("start") + F.col("place")).alias("at"), "total"), n


def _groups(batches, columns: Sequence[str]):
    """Lists of row tuples that share key and chunk, of sorted batches."""
    held, now = [], None
    for b in batches:
        for k, c, *rest in zip(b.column("key").to_pylist(), b.column("chunk").to_pylist(), *[b.column(x).to_pylist() for x in columns]):
            if (k, c) != now and held:
                yield *now, held
                held = []
            now = k, c
            held.append(rest)
    if held:
        yield *now, held


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(_parts(n), "key", "chunk").sortWithinPartitions("key", "chunk", "at")


def _built(nodes: DataFrame, n: int, paths: bool, depth: int) -> DataFrame:
    """Of nodes (key, at, total, digest): a row (key, at, total, digest) for each chunk, its top, and if asked a row (key, at, path) for each node."""

    chunk_rows = FAN**depth

    def build(batches):
        out = pa.schema([("key", pa.string()), ("at", pa.int64()), ("total", pa.int64()), ("digest", pa.binary()), ("path", _PATH)])
        for key, chunk, rows in _groups(batches, ("at", "total", "digest")):
            total = rows[0][1]
            tree = Subtree([r[2].hex().encode() for r in rows], min(depth, levels(total)))
            made = [{"key": key, "at": chunk, "total": -(-total // chunk_rows), "digest": bytes.fromhex(tree.top.decode()), "path": None}]
            if paths:
                made += [{"key": key, "at": r[0], "total": None, "digest": None, "path": [{"slot": s, "run": p.run} for s, p in tree.path(r[0] % chunk_rows)]} for r in rows]
            yield pa.RecordBatch.from_pylist(made, schema=out)

    cut = nodes.select("key", _div("at", chunk_rows).alias("chunk"), "at", "total", "digest")
    return stored(_dealt(cut, n).mapInArrow(build, f"key string, at long, total long, digest binary, path {PATH}"))


def _tree(nodes: DataFrame, n: int, depth: int, paths: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of nodes (key, at, total, digest): (key, digest) of each key's root; (key, at, path) of each node, or of each chunk of nodes if not `paths`."""
    found = []
    while True:
        made = _built(nodes, n, paths, depth)
        if paths:
            found.append(made.filter("path is not null").select("key", "at", "path"))
        nodes = made.filter("path is null").select("key", "at", "total", "digest")
        n, most = nodes.agg(F.count("*"), F.max("total")).first()
        if (most or 1) <= 1:
            break
        paths = True
    roots = nodes.select("key", "digest")
    if not found:  # each key is one chunk, whose top is its root
        return roots, roots.select("key", F.lit(0).cast("long").alias("at"), F.array().cast(PATH).alias("path"))
    whole = found[-1]
    for below in reversed(found[:-1]):
        upper = whole.select("key", F.col("at").alias("up"), F.col("path").alias("rest"))
        whole = below.withColumn("up", _div("at", FAN**depth)).join(upper, ["key", "up"]).select("key", "at", F.concat("path", "rest").alias("path"))
    return roots, whole


@dataclass(frozen=True)
class Manifest:
    """leaves: (key, at, total, id, leaf, claim), digests as bytes; paths: (key, chunk, path, subroot, root) from each chunk of leaves to the root; rows: number of leaves; depth:
    levels that a chunk has at most."""

    leaves: DataFrame
    paths: DataFrame
    rows: int
    depth: int

    @property
    def root(self) -> str | None:
        """Lower-case hex; None for an empty table."""
        row = self.paths.select(F.lower(F.hex("root"))).first()
        return None if row is None else row[0]


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", claim: Column | None = None, depth: int = DEPTH) -> Manifest:
    """The tree over docs. claim: a digest in hex that is to be verified in the row's place, null for the row's own."""
    key = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    own = leaf([F.col(f) for f in fields])
    digests = docs.select(key.alias("key"), F.col(id_col).alias("id"), F.unhex(own).alias("leaf"), F.unhex(F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    leaves, n = numbered(stored(digests), ["id", "leaf"])
    roots, chunks = _tree(leaves.select("key", "at", "total", F.col("leaf").alias("digest")), n, depth, paths=False)
    groups, n_groups = numbered(stored(roots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")), ["group"])
    top, ways = _tree(groups.select("key", "at", "total", "digest"), n_groups, depth)
    named = groups.join(ways, ["key", "at"]).join(F.broadcast(top.select(F.col("digest").alias("root"))))  # one row
    named = named.select(F.col("group").alias("key"), F.col("path").alias("rest"), F.col("digest").alias("subroot"), "root")
    paths = chunks.join(named, "key").select("key", F.col("at").alias("chunk"), F.concat("path", "rest").alias("path"), "subroot", "root")
    return Manifest(leaves, stored(paths), n, depth)


def proofs(held: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (hash of the leaf's siblings, level by level), folded_root (from the claim, else the leaf, and
    the siblings), verified (folded_root is the root); all digests in lower-case hex. A chunk's path travels with its leaves, before the first."""
    depth, chunk_rows = held.depth, FAN**held.depth

    def prove(batches):
        out = pa.schema([(c, pa.int64() if c == "doc_id" else pa.string()) for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")])
        for _, _, rows in _groups(batches, ("at", "total", "id", "leaf", "claim", "path", "subroot", "root")):
            (*_, way, subroot, root), *docs = rows
            tree = Subtree([r[3].hex().encode() for r in docs], min(depth, levels(docs[0][1])))
            upper = [(w["slot"], Parent([w["run"][i : i + 64] for i in range(0, len(w["run"]), 64)])) for w in way]
            above = b"".join(p.others(s) for s, p in upper)
            made = [[], [], [], [], [], []]
            for at, _, name, digest, claim, *_ in docs:
                path = tree.path(at % chunk_rows)
                proof = sha256()
                for slot, parent in path:
                    proof.update(parent.others(slot))
                proof.update(above)
                start = (digest if claim is None else claim).hex().encode()
                end = folded(upper, folded(path, start))
                for column, value in zip(made, (name, digest.hex(), subroot.hex(), root.hex(), proof.hexdigest(), end.decode())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, out.types)], schema=out)

    nothing = lambda t, c: F.lit(None).cast(t).alias(c)
    docs = held.leaves.select("key", _div("at", chunk_rows).alias("chunk"), "at", "total", F.col("id").cast("long").alias("id"), "leaf", "claim", nothing(PATH, "path"), nothing("binary", "subroot"), nothing("binary", "root"))
    ways = held.paths.select("key", "chunk", F.lit(-1).cast("long").alias("at"), nothing("long", "total"), nothing("long", "id"), nothing("binary", "leaf"), nothing("binary", "claim"), "path", "subroot", "root")
    found = _dealt(docs.unionByName(ways), held.rows).mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(which: Column, fields: Sequence[str] = FIELDS, text_col: str = "text") -> Column:
    """The digest that a row has with A-Z of its text in lower case, where `which` holds; null elsewhere."""
    return F.when(which, leaf([F.translate(F.col(f), CAPITALS, SMALL) if f == text_col else F.col(f) for f in fields]))
