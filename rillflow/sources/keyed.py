"""Keyed tables in buckets: a merge rewrites the buckets that its rows touch, and the table's constraints hold in every version.

Rows lie in `buckets` folders by a hash of their key. A version is a record (bucket -> folder, rows, marks); a merge reads the touched buckets,
writes them anew and claims the next record, which names the old folders for all others. Rows and marks (such as a load's high-water mark, or the last
message handled) thus become visible together, or not at all; of two writers one wins and the other merges again.

Unique columns beside the key have an index in buckets of the value, published with the rows: only the index buckets of new values are read.
Values of unique columns never change once a row is stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.merge import key_conflicts, upsert
from rillflow.sources.store import Raced, claim, kept, newest, swept


class Violates(ValueError):
    """Rows that break a constraint: a frame of them, with the broken rule."""

    def __init__(self, rule: str, rows: DataFrame):
        super().__init__(rule)
        self.rule, self.rows = rule, rows


@dataclass(frozen=True)
class Version:
    number: int = -1
    folders: dict[str, dict[int, str]] = field(default_factory=dict)
    rows: int = 0
    marks: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Merged:
    """Counts of a merge; touched: buckets that were rewritten; conflicts: rows left out because another key holds their unique value."""

    version: Version
    inserted: int
    updated: int
    touched: list[int]
    conflicts: DataFrame | None


ROWS = "rows"


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    buckets: int = 64
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()

    def version(self) -> Version:
        found = newest(self.spark, self.path)
        if found is None:
            return Version()
        number, held = found
        return Version(number, {part: {int(b): f for b, f in where.items()} for part, where in held["folders"].items()}, held["rows"], held["marks"])

    def bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def read(self, version: Version | None = None, buckets: Iterable[int] | None = None, part: str = ROWS) -> DataFrame:
        """A version's rows, of some buckets if given: only their files are listed and read."""
        version = version or self.version()
        schema = self.schema if part == ROWS else T.StructType([self.schema[part], self.schema[self.key]])
        where = version.folders.get(part, {})
        paths = [f"{self.path}/data/{where[b]}/bucket={b}" for b in (sorted(where) if buckets is None else buckets) if b in where]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _written(self, rows: DataFrame, column: str) -> str:
        """A new folder with the rows by bucket."""
        folder = uuid.uuid4().hex
        rows.withColumn("bucket", self.bucket(column)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return folder

    def merge(
        self,
        new: DataFrame,
        fixed: tuple[str, ...] = (),
        ignore: bool = False,
        seq: str | None = None,
        marks: dict[str, int] | Callable[[Version], dict[str, int]] | None = None,
        repaired: Callable[[DataFrame], DataFrame] = lambda df: df,
        attempts: int = 10,
    ) -> Merged:
        """Merges rows (one for each key) and sets marks. `ignore` leaves stored rows as they are. With `seq`, rows whose unique value is taken, by a stored
        row or an earlier new one, are left out and returned; without it they refuse the merge, as nulls in not_null columns do."""
        extra = [] if seq is None or seq in self.schema.names else [seq]
        new = kept(new.select(*self.schema.names, *extra, self.bucket(self.key).alias("bucket")))
        touched = [r["bucket"] for r in new.select("bucket").distinct().orderBy("bucket").collect()]  # at most `buckets`
        fixed = (*fixed, *[c for c in self.unique if c not in fixed])
        for _ in range(attempts):
            held = self.version()
            folders, conflicts, merged = {part: dict(where) for part, where in held.folders.items()}, None, {"inserted": 0, "updated": 0}
            if touched:
                old, rows = self.read(held, touched), new.drop("bucket")
                if self.unique:
                    rows, conflicts = self._indexed(held, old, rows, seq, folders)
                both = upsert(old, rows.select(*self.schema.names), self.key, tuple(self.schema.names) if ignore else fixed)
                seen = Observation()
                counts = [F.count_if(F.col("action") == a).alias(a) for a in merged]
                broken = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in self.not_null]
                folder = self._written(repaired(both.observe(seen, *counts, *broken).drop("action")), self.key)
                merged = seen.get
                for c in self.not_null:
                    if merged[f"null_{c}"]:
                        raise Violates(f"not null: {c}", self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").filter(F.col(c).isNull()))
                folders.setdefault(ROWS, {}).update(dict.fromkeys(touched, folder))
            given = marks(held) if callable(marks) else marks or {}
            following = Version(held.number + 1, folders, held.rows + merged["inserted"], held.marks | given)
            if claim(self.spark, self.path, following.number, {"folders": following.folders, "rows": following.rows, "marks": following.marks}):
                return Merged(following, merged["inserted"], merged["updated"], touched, conflicts)
        raise Raced(f"{attempts} other merges came first")

    def _indexed(self, held: Version, old: DataFrame, rows: DataFrame, seq: str | None, folders: dict) -> tuple[DataFrame, DataFrame]:
        """(rows to merge, conflicts); puts the index buckets of new values, written anew, into `folders`."""
        order, left = seq or "__seq", []
        rows = rows if seq else rows.withColumn(order, F.monotonically_increasing_id())
        fresh = kept(rows.join(old.select(self.key), self.key, "left_anti").select(self.key, order, *self.unique))
        taken = {}
        for c in self.unique:
            values = fresh.filter(F.col(c).isNotNull())
            taken[c] = [r["b"] for r in values.select(self.bucket(c).alias("b")).distinct().collect()]
            left.append(key_conflicts(self.read(held, taken[c], c), values, self.key, c, order).select(self.key, F.lit(f"unique: {c}").alias("rule")))
        gone = left[0]
        for more in left[1:]:
            gone = gone.unionByName(more)
        gone = kept(gone.dropDuplicates([self.key]))
        conflicts = rows.join(gone, self.key)
        if seq is None and not gone.isEmpty():
            raise Violates(gone.first()["rule"], conflicts.drop(order))
        for c in self.unique:
            if taken[c]:
                stays = fresh.filter(F.col(c).isNotNull()).join(gone, self.key, "left_anti").select(c, self.key)
                folder = self._written(self.read(held, taken[c], c).unionByName(stays), c)
                folders.setdefault(c, {}).update(dict.fromkeys(taken[c], folder))
        return rows.join(gone.select(self.key), self.key, "left_anti"), conflicts.select(*self.schema.names, "rule")

    def mark(self, marks: dict[str, int]) -> Version:
        """Sets marks alone."""
        for _ in range(10):
            held = self.version()
            following = Version(held.number + 1, held.folders, held.rows, held.marks | marks)
            if claim(self.spark, self.path, following.number, {"folders": following.folders, "rows": following.rows, "marks": following.marks}):
                return following
        raise Raced("10 other merges came first")

    def sweep(self, keep: int = 2) -> list[str]:
        """Deletes folders that the last `keep` versions do not name: old buckets, and what refused or lost merges have left."""
        return swept(self.spark, self.path, lambda held: {f for where in held["folders"].values() for f in where.values()}, f"{self.path}/data", keep)
