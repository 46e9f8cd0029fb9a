"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step only looks at what the one before could not tell apart; the full content is hashed only for rows whose
length and prefix hash another row shares.

Texts are equal when identical after each run of ASCII white space is replaced by one space. Defined cases: null counts as
empty; of equal texts the row with the smallest id stays, null ids only where there is no other; of rows with equal
id and text one stays; an empty table gives an empty result; other columns, whatever their names, pass through `exact_dedup` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import stored

#: Surviving (length, prefix) keys are broadcast up to this many (24 bytes each); beyond it the rows are shuffled to them.
BROADCAST_KEYS = 200_000
PREFIX_CHARS = 128


def normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def refined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs' rows as one column __row (or only id and `carry`, if given) plus __full: hash of the whole text, null where the text is unique.

    `carry` holds columns made from __norm, the normalised text.
    """
    norm = docs.select(F.struct("*").alias("__row"), normalised(text_col).alias("__norm"))
    signed = norm.withColumns({"__len": F.octet_length("__norm"), "__prefix": F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS))})
    light = stored(signed.select("__len", "__prefix"))
    lengths = light.groupBy("__len").count().filter("count > 1").select("__len")
    keys = stored(light.join(lengths, "__len", "left_semi").groupBy("__len", "__prefix").count().filter("count > 1").select("__len", "__prefix", F.lit(True).alias("__again")))
    if keys.count() <= broadcast_keys:
        keys = F.broadcast(keys)
    full = F.when(F.col("__again"), F.sha2(F.encode("__norm", "UTF-8"), 256)).alias("__full")
    names = ["__row"] if carry is None else [F.col("__row")[id_col].alias(id_col)]
    return signed.join(keys, ["__len", "__prefix"], "left").select(*names, full, *[c.alias(k) for k, c in (carry or {}).items()])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, and what `carry` makes of __norm.

    Groups are counted before they are shuffled; the join back is an inner join of small rows that adaptive execution
    may split where a group is hot.
    """
    carry = carry or {}
    rows = stored(refined(docs, id_col, text_col, carry).withColumnRenamed(id_col, "doc_id"))
    extra = list(carry)
    alone = rows.filter("__full is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *extra)
    again = rows.filter("__full is not null")
    groups = again.groupBy("__full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    copies = again.groupBy("__full", "doc_id").agg(F.count("*").cast("int").alias("__n"), *[F.first(c).alias(c) for c in extra])
    member = copies.join(groups, "__full").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    member = member.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__i") == 1)).alias("kept"), *extra)
    return alone.unionByName(member)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, in their own columns. Texts that no other row shares are never shuffled."""
    rows = refined(docs, id_col, text_col)
    alone = rows.filter("__full is null").select("__row")
    again = rows.filter("__full is not null").withColumn("__id", F.col("__row")[id_col])
    kept = again.groupBy("__full").agg(F.min("__id").alias("__keep")).withColumnRenamed("__full", "__hash")
    again = again.join(kept, (F.col("__full") == F.col("__hash")) & F.col("__id").eqNullSafe(F.col("__keep")))
    return alone.union(again.dropDuplicates(["__full"]).select("__row")).select("__row.*")
