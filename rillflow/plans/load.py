"""The load of a results file as one call: read, check, merge by url, repair, publish, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import merge as U
from rillflow.operators import validate as V
from rillflow.schemas import ORIGINS, REQUIRED_COLUMNS, RESULTS
from rillflow.sources.keyed import KeyedTable
from rillflow.sources.store import kept


@dataclass(frozen=True)
class Loaded:
    """rows: of the published version; summary: inserted, updated, skipped; rejected: (reject_id, missing); conflicts: rows whose id another url holds."""

    rows: int
    summary: DataFrame
    rejected: DataFrame
    conflicts: DataFrame


def results_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The table of results: keyed by url, with the constraints of its columns."""
    return KeyedTable(spark, path, RESULTS, "url", buckets, not_null=REQUIRED_COLUMNS, unique=("p_id",))


def repaired(df: DataFrame) -> DataFrame:
    """Values out of range become null, unknown origins Other."""
    return V.repair_category(V.repair_ranges(df), "us_or_international", [*ORIGINS.values(), "Other"])


def load_results(raw: DataFrame, table: KeyedTable, seq: str, rules: V.Rules = V.Rules(), marks: dict[str, int] | None = None) -> Loaded:
    """Merges raw results, in the order of `seq`, into the table. All of it appears, or nothing.

    Rows that fail the checks and rows whose id another url holds are skipped; of several rows with one url the last value of each column
    counts; rows are repaired as they are merged, so every stored row is. Only the buckets of the rows' urls and ids are read and written.
    """
    checked = kept(V.converted(raw, rules))
    new = U.last_non_null(V.valid_rows(checked).select(*RESULTS.names, seq), "url", seq)
    done = table.merge(new, seq=seq, repaired=repaired, marks=marks)
    rejected = V.rejects(checked)
    none = table.spark.createDataFrame([], table.schema).withColumn("rule", F.lit(""))
    conflicts = none if done.conflicts is None else done.conflicts
    skipped = rejected.count() + conflicts.count()
    summary = table.spark.createDataFrame([(done.inserted, done.updated, skipped)], "inserted long, updated long, skipped long")
    return Loaded(done.version.rows, summary, rejected, conflicts)
