"""Readers and writers of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.schemas import RAW
from rillflow.sources.errors import FAILURES, MALFORMED, MISSING, conditions


def read_array(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """Files that are one JSON array of objects each; a malformed file fails the read. Keys match by letter case."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_array(spark: SparkSession, path: str, schema: T.StructType = RAW) -> tuple[DataFrame, str | None]:
    """(rows, None); or (no rows, reason) where a file is missing or malformed, so that nothing is loaded and the reason is reported."""
    try:
        df = read_array(spark, path, schema)
        df.agg(F.max(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))).collect()  # parses every file now
        return df, None
    except FAILURES as e:
        found = conditions(e) & (MISSING | MALFORMED)
        if not found:
            raise
        return spark.createDataFrame([], schema), min(found)


def read_lines(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """JSON Lines; blank lines are skipped, malformed lines fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """Either [row, ...] or {"rows": [row, ...]}; anything else is no rows."""
    wide = T.StructType([*schema.fields, T.StructField("rows", T.ArrayType(schema))])
    df = spark.read.schema(wide).option("multiLine", True).json(path)
    one = F.struct(*[F.col(f"`{f}`") for f in schema.names])
    every = F.when(F.col("rows").isNotNull(), F.col("rows")).when(F.coalesce(*[F.col(f"`{f}`") for f in schema.names]).isNotNull(), F.array(one))
    return df.select(F.inline(every))


def convert(spark: SparkSession, source: str, target: str, schema: T.StructType = RAW, to: str = "parquet") -> None:
    """JSON Lines to another format."""
    read_lines(spark, source, schema).write.format(to).save(target)


def append(df: DataFrame, path: str) -> None:
    """All rows or none appear: the writer's commit protocol."""
    df.write.mode("append").parquet(path)


def known_urls(df: DataFrame, column: str = "url") -> DataFrame:
    return df.select(column).filter(F.col(column) != "").distinct()


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row with a key; the filter reaches the file scan."""
    return df.filter(F.col(key) == value).limit(1)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, line): a reference list, one name a line, trimmed, empty lines dropped; no rows where there is no file.

    line is the order of the lines, files by name: each file is read whole, so lists stay small files.
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except FAILURES as e:
        if not conditions(e) & MISSING:
            raise
        return spark.createDataFrame([], "name string, line long")
    order = F.array(*[F.lit(f) for f in sorted(files.inputFiles())])
    number = F.array_position(order, F.input_file_name())
    lines = files.select(number.alias("file"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("pos", "name"))
    return lines.select(F.trim("name").alias("name"), (F.col("file") * F.lit(1 << 32) + F.col("pos")).alias("line")).filter("name <> ''")
