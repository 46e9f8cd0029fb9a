"""Task streams: decode, route by kind, quarantine the rest; a ledger of messages; merges for each micro-batch.

What a batch does twice after a failure changes nothing: routed results are overwritten under the batch's number, merges carry the batch or the
message in the marks of the table's record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators.merge import last_non_null
from rillflow.schemas import TASK
from rillflow.sources.keyed import KeyedTable
from rillflow.sources.store import kept


def decoded(messages: DataFrame, column: str = "value") -> DataFrame:
    """kind, ts, payload and the raw text; kind is null for malformed bodies. A missing payload is empty."""
    m = F.from_json(column, TASK)
    payload = F.coalesce(m["payload"], F.create_map().cast("map<string,string>"))
    return messages.select(m["kind"].alias("kind"), m["ts"].alias("ts"), payload.alias("payload"), F.col(column).alias("raw"))


def routed(tasks: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tasks of known kinds, quarantined rows with a reason)."""
    known = F.col("kind").isin(kinds)
    reason = F.when(F.col("kind").isNull(), "malformed").otherwise("unknown kind")
    return tasks.filter(known), tasks.filter(F.col("kind").isNull() | ~known).withColumn("reason", reason)


def run_tasks(stream: DataFrame, kinds: dict[str, Callable[[DataFrame, int], None]], quarantine: str, checkpoint: str) -> None:
    """Hands each batch's tasks to their kind's handler; a handler that fails sends its tasks to quarantine and the stream goes on."""

    def batch(df: DataFrame, number: int) -> None:
        read = decoded(df).persist()  # each kind and the quarantine read it
        tasks, bad = routed(read, list(kinds))
        rest = bad.select("raw", "reason")
        for kind, handle in kinds.items():
            mine = tasks.filter(F.col("kind") == kind)
            if mine.isEmpty():
                continue
            try:
                handle(mine, number)
            except Exception as e:  # noqa: BLE001  the message is dropped to quarantine, not retried
                rest = rest.unionByName(mine.select("raw", F.lit(f"failed: {type(e).__name__}").alias("reason")))
        rest.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        read.unpersist()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_upserts(stream: DataFrame, table: KeyedTable, seq: str, fixed: tuple[str, ...], checkpoint: str, after: Callable[[KeyedTable, int], None] | None = None) -> None:
    """Merges each batch into a keyed table: of one key's rows the last value of each column counts. A batch that is repeated after a failure
    finds its number among the table's marks and merges nothing.

    `after`, if given, gets the table and the batch's number: here reports are made anew.
    """

    def batch(df: DataFrame, number: int) -> None:
        if table.version().marks.get("batch", -1) < number:
            table.merge(last_non_null(df, table.key, seq), fixed, marks={"batch": number})
        if after is not None:
            after(table, number)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


Handler = Callable[[dict, dict], None]

#: Steps are numbered by batch and place in it.
MOST_MESSAGES = 1_000_000


def handle_messages(messages: DataFrame, number: int, table: KeyedTable, handlers: dict[str, Handler], quarantine: str) -> None:
    """Handles a batch's messages one by one in the order of their times; the table's records are the ledger.

    A handler gets the payload and the marks to commit with what it merges, so that rows and the message's mark appear in one record. A message that fails,
    of an unknown kind or malformed goes to quarantine (raw, reason), and nothing of it is visible. If the batch comes again after a crash, messages
    whose step is marked are skipped. A batch holds the few messages of its files.
    """
    for n, m in enumerate(decoded(messages).orderBy("ts", "raw").collect()):
        step = number * MOST_MESSAGES + n
        if table.version().marks.get("step", -1) >= step:
            continue
        reason = None
        if m["kind"] is None:
            reason = "malformed"
        elif m["kind"] not in handlers:
            reason = "unknown kind"
        else:
            try:
                handlers[m["kind"]](m["payload"], {"step": step})
            except Exception as e:  # noqa: BLE001  the message is dropped to quarantine, not retried
                reason = f"failed: {type(e).__name__}"
        if reason is not None:
            table.spark.createDataFrame([(m["raw"], reason)], "raw string, reason string").coalesce(1).write.mode("overwrite").parquet(f"{quarantine}/step={step}")
        if table.version().marks.get("step", -1) < step:
            table.mark({"step": step})


def run_messages(stream: DataFrame, table: KeyedTable, handlers: dict[str, Handler], quarantine: str, checkpoint: str) -> None:
    """The stream's messages through handle_messages, batch by batch; a message that fails does not end the stream."""

    def batch(df: DataFrame, number: int) -> None:
        handle_messages(df, number, table, handlers, quarantine)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def incremental_loads(table: KeyedTable, read: Callable[[str], DataFrame], source: str, seq: str) -> Handler:
    """A handler that loads the rows of a feed whose key is above the source's mark, or above `since` if the payload names it; stored keys stay as they are,
    of new rows with one key the first in seq order counts, and the mark rises to the greatest key that was asked for."""
    name = f"mark:{source}"

    def load(payload: dict, marks: dict) -> None:
        if not payload.get("path"):
            raise ValueError("the payload names no path")
        since = payload.get("since")
        above = table.version().marks.get(name, -1) if since is None else int(since)
        rows = kept(read(payload["path"]).filter(F.col(table.key) > above))
        top = rows.agg(F.max(table.key)).first()[0]
        rest = [c for c in table.schema.names if c != table.key]
        first = rows.groupBy(table.key).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(table.key, "r.*")
        table.merge(first, ignore=True, marks=lambda held: marks | ({} if top is None else {name: max(held.marks.get(name, -1), int(top))}))

    return load
