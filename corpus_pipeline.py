"""A training-corpus pipeline of five stages over `documents`; each stage is one of the corpus operators.

Toxic documents go, then exact copies, near copies, documents that hold benchmark items; what is left is tokenised.

Defined cases, of all stages and of run(): null texts count as empty and are scored, compared, judged and tokenised like any other text; rows
with null or repeated ids are judged by their own text; of equal or near equal texts the row with the smallest id stays (null ids last), of
rows with equal id and text one; texts of any length are read whole; an empty table gives an empty result; extra columns, whatever their
names, pass through all stages but the last, which returns doc_id, n_tokens, ids and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import stored, table
from rillflow.llm.queries import vocabulary

#: No SQL: the first stage is a learnt model, the last a tokenizer. tests/llm checks run() against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.3; the model learns from a bounded sample of labelled rows that the fold does not hold out."""
    from rillflow.llm.toxicity import fit, fold, keep_clean

    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels"), usable=fold("doc_id", 4) != 2))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space apart."""
    from rillflow.llm.exact_dedup import exact_dedup

    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that five-word shingles with a Jaccard similarity of 0.8 or more link. op3's method on wider SimHash fingerprints: an index
    over their byte positions, count filtering, then an exact check; op3's own contract is fingerprints within 4 bits."""
    from rillflow.llm.near_copies import near_copies

    return near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark item."""
    from rillflow.llm.decontaminate import clean_rows

    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little-endian), decoded_sha256."""
    from rillflow.llm.bpe import bpe_encode_decode

    coded = bpe_encode_decode(docs, vocabulary("byte_bpe_50k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near-dedup", near), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
