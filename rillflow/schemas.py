"""Explicit schemas of the record types."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: The keys of a raw result (all strings, absent keys are null).
REQUIRED = ["program", "date added", "url", "status", "term", "US/International", "degree"]
OPTIONAL = ["comments", "GPA", "GRE score", "GRE V score", "GRE AW", "llm-generated-program", "llm-generated-university"]
RAW = _strings(*REQUIRED, *OPTIONAL)

#: The columns of a stored result, and those that are never null.
RESULTS = T.StructType(
    [
        T.StructField("p_id", T.IntegerType()),
        T.StructField("program", T.StringType()),
        T.StructField("comments", T.StringType()),
        T.StructField("date_added", T.DateType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("us_or_international", T.StringType()),
        *[T.StructField(n, T.DoubleType()) for n in ("gpa", "gre", "gre_v", "gre_aw")],
        T.StructField("degree", T.StringType()),
        T.StructField("llm_generated_program", T.StringType()),
        T.StructField("llm_generated_university", T.StringType()),
    ]
)
REQUIRED_COLUMNS = ("p_id", "program", "date_added", "url", "status", "term", "us_or_international", "degree")
MARKS = T.StructType([T.StructField("source", T.StringType()), T.StructField("last_seen", T.StringType()), T.StructField("updated_at", T.TimestampType())])
TASK = T.StructType([T.StructField("kind", T.StringType()), T.StructField("ts", T.StringType()), T.StructField("payload", T.MapType(T.StringType(), T.StringType()))])

#: Valid ranges of the scores, categories of origin.
SCORE_RANGES = {"gpa": [(0, 4)], "gre": [(130, 170)], "gre_v": [(130, 170)], "gre_aw": [(0, 6)]}
ORIGINS = {"american": "American", "international": "International"}
