"""Versioned tables: a new version is written beside the old one, then a numbered record names it.

A record's number is claimed by an exclusive create, so of two writers one wins and the other tries the next number, against what the first has
published. The record holds the version's rows: one that holds fewer than the current one is refused without counting either. Readers see the old or the new
version, never a part. A newest version that is missing or corrupt counts as none, and the next publication takes its place.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rillflow.sources.errors import CORRUPT, FAILURES, MISSING, conditions


class Shrinks(ValueError):
    """The new version would hold fewer rows than the one it replaces."""


class Raced(RuntimeError):
    """Other writers were faster again and again."""


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master, an error elsewhere."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = getattr(spark, "_rillflow_folder", None)
    if where is None:
        where = spark._rillflow_folder = "file://" + tempfile.mkdtemp(prefix="rillflow-")
    return where


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark)}/rillflow-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def claim(spark: SparkSession, path: str, number: int, held: dict) -> bool:
    """Makes a record the one of a number; False if another writer has taken the number. A record is whole or does not exist."""
    fs, folder = _files(spark, path)
    staged, target = (spark._jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f".{uuid.uuid4().hex}", f"{number:012d}.json"))
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return fs.rename(staged, target)  # refused where the target exists
        nio = [spark._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, staged)]
        spark._jvm.java.nio.file.Files.createLink(*nio)  # a local rename would overwrite
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        fs.delete(staged, False)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has been committed."""
    fs, _ = _files(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))


def newest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """The record of the greatest number; None where there is none."""
    found = max(_numbers(spark, path), default=None)
    if found is None:
        return None
    fs, folder = _files(spark, path)
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{found:012d}.json"))
    try:
        return found, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]


def swept(spark: SparkSession, path: str, used: Callable[[dict], set[str]], data: str, keep: int = 2) -> list[str]:
    """Deletes records but the last `keep`, and the folders in `data` that none of these uses; returns the folders. No writer may be at work."""
    fs, folder = _files(spark, path)
    numbers, needed, gone = sorted(_numbers(spark, path)), set(), []
    for n in numbers[-keep:]:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n:012d}.json"))
        needed |= used(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        stream.close()
    for n in numbers[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n:012d}.json"), False)
    root = spark._jvm.org.apache.hadoop.fs.Path(data)
    for f in fs.listStatus(root) if fs.exists(root) else []:
        name = f.getPath().getName()
        if f.isDirectory() and name != "versions" and name not in needed:
            fs.delete(f.getPath(), True)
            gone.append(name)
    return gone


def _readable(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)  # reads a footer
    except FAILURES as e:
        if conditions(e) & (MISSING | CORRUPT):
            return None
        raise


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version; None where there is none, or it is missing or corrupt."""
    held = newest(spark, path)
    return None if held is None else _readable(spark, f"{path}/{held[1]['version']}")


def publish(df: DataFrame, path: str, guard: bool = True, attempts: int = 10) -> int:
    """Writes and names a new version; returns its rows, which are counted while they are written. The guard compares records, no rows are read."""
    spark, version, seen = df.sparkSession, f"v-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{version}")
    rows = seen.get["rows"]
    for _ in range(attempts):
        held = newest(spark, path)
        lost = held is None or (guard and _readable(spark, f"{path}/{held[1]['version']}") is None)
        if guard and not lost and rows < held[1]["rows"]:
            raise Shrinks(f"{rows} rows would replace {held[1]['rows']}")
        if claim(spark, path, 0 if held is None else held[0] + 1, {"version": version, "rows": rows}):
            return rows
    raise Raced(f"{attempts} other publications came first")


def sweep(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes all versions but the last `keep`, and what refused or failed publications have left."""
    return swept(spark, path, lambda held: {held["version"]}, path, keep)
