"""Task messages: compact JSON of kind, UTC time and payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def message(kind: Column, ts: Column, payload: Column | None = None) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.to_json(F.struct(kind.alias("kind"), ts.alias("ts"), (empty if payload is None else F.coalesce(payload, empty)).alias("payload")))


def write_messages(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.mode("append").text(path)


def message_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """New files of a folder as a stream of raw messages, `files` of them a batch."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(path)
