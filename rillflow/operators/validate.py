"""Row checks: required fields, conversions, reject reports, constraints and table-wide repairs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import text as X
from rillflow.schemas import ORIGINS, REQUIRED, RESULTS, SCORE_RANGES


@dataclass(frozen=True)
class Rules:
    """How raw results become rows. `lenient` is the incremental load's variant: an empty string is a value, the date may stand
    anywhere in its text, categories stay as they are and scores are not loaded."""

    required: list[str] = field(default_factory=lambda: list(REQUIRED))
    lenient: bool = False
    path: str = "/result/"


def missing_fields(required: list[str], empty_is_missing: bool = True) -> Column:
    """Names of all required fields that are absent (or empty), as array<string>."""
    cols = {c: F.col(f"`{c}`") for c in required}
    absent = [F.when(v.isNull() | (v == "") if empty_is_missing else v.isNull(), F.lit(c)) for c, v in cols.items()]
    return F.filter(F.array(*absent), lambda x: x.isNotNull())


def _date(rules: Rules) -> Column:
    if not rules.lenient:
        return X.added_date("`date added`")
    found = F.regexp_extract(F.col("`date added`"), r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s*\d{4})", 1)
    return F.try_to_timestamp(F.regexp_replace(X.collapsed(found), r"^([A-Z][a-z]{2})[a-z]* (\d+), ?", "$1 $2, "), F.lit("MMM d, yyyy")).cast("date")


def converted(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The 15 typed columns, `missing` (names of what is missing or cannot be read) and `reject_id`; other columns stay."""
    opt = lambda c: X.null_if_empty(F.col(f"`{c}`"))
    score = lambda c, kind: F.lit(None).cast("double") if rules.lenient else X.first_number(f"`{c}`", SCORE_RANGES[kind])
    kept = [c for c in raw.columns if c not in RESULTS.names and c not in rules.required and c not in ("comments", "GPA", "GRE score", "GRE V score", "GRE AW", "llm-generated-program", "llm-generated-university")]
    gone, origin = missing_fields(rules.required, not rules.lenient), F.col("`US/International`")
    read = F.struct(
        X.id_after("url", rules.path).alias("__id"),
        _date(rules).alias("__date"),
        gone.alias("__gone"),
        (origin if rules.lenient else X.mapped(origin, ORIGINS, "Other")).alias("__origin"),
        *[score(c, kind).alias(f"__{kind}") for c, kind in (("GPA", "gpa"), ("GRE score", "gre"), ("GRE V score", "gre_v"), ("GRE AW", "gre_aw"))],
    )
    # The generator keeps what is parsed below later filters, so that nothing is parsed twice.
    raw = raw.select("*", F.inline(F.array(read)))
    p_id, date, gone = F.col("__id"), F.col("__date"), F.col("__gone")
    bad = F.filter(F.array(F.when(~F.array_contains(gone, "date added") & date.isNull(), F.lit("date_added")), F.when(~F.array_contains(gone, "url") & p_id.isNull(), F.lit("p_id"))), lambda x: x.isNotNull())
    return raw.select(
        p_id.alias("p_id"),
        "program",
        opt("comments").alias("comments"),
        date.alias("date_added"),
        "url",
        "status",
        "term",
        F.col("__origin").alias("us_or_international"),
        *[F.col(f"__{kind}").alias(kind) for kind in SCORE_RANGES],
        "degree",
        opt("llm-generated-program").alias("llm_generated_program"),
        opt("llm-generated-university").alias("llm_generated_university"),
        F.concat(gone, bad).alias("missing"),
        F.coalesce(p_id.cast("string"), F.col("url"), F.lit("unknown url")).alias("reject_id"),
        *[F.col(f"`{c}`") for c in kept],
    )


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("missing") == 0).drop("missing", "reject_id")


def rejects(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("missing") > 0).select("reject_id", "missing")


def constraint_report(df: DataFrame, not_null: list[str], unique: list[str]) -> DataFrame:
    """(rule, violations): null counts, and how many values of each unique column occur more than once."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
    out = nulls.select(F.explode(F.array(*[F.struct(F.lit(f"not null: {c}").alias("rule"), F.col(c).alias("violations")) for c in not_null])).alias("x")).select("x.*")
    for c in unique:
        again = df.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1").agg(F.count("*").alias("violations"))
        out = out.unionByName(again.select(F.lit(f"unique: {c}").alias("rule"), "violations"))
    return out


def load_summary(actions: DataFrame, rejected: DataFrame, most: int = 100) -> DataFrame:
    """One row to print: inserted, updated, skipped and the first `most` of the skipped rows' ids; `rejects` has all of them."""
    counts = actions.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"))
    ids = rejected.orderBy("reject_id").limit(most).agg(F.array_join(F.array_sort(F.collect_list("reject_id")), ",").alias("skipped_ids"))
    return counts.crossJoin(rejected.agg(F.count("*").alias("skipped"))).crossJoin(ids)  # three rows of one


def repair_ranges(df: DataFrame, ranges: dict[str, list[tuple[float, float]]] | None = None) -> DataFrame:
    """Values outside all ranges of their column become null."""
    return df.withColumns({c: F.when(X.in_ranges(F.col(c), r), F.col(c)) for c, r in (ranges or SCORE_RANGES).items() if c in df.columns})


def out_of_range(df: DataFrame, ranges: dict[str, list[tuple[float, float]]] | None = None) -> DataFrame:
    """One row: how many values repair_ranges clears in each column. One pass."""
    ranges = {c: r for c, r in (ranges or SCORE_RANGES).items() if c in df.columns}
    return df.agg(*[F.count_if(F.col(c).isNotNull() & ~X.in_ranges(F.col(c), r)).alias(c) for c, r in ranges.items()])


def repair_category(df: DataFrame, column: str, allowed: list[str], default: str = "Other") -> DataFrame:
    """Values outside the list become the default; nulls stay."""
    return df.withColumn(column, F.when(~F.col(column).isin(allowed), default).otherwise(F.col(column)))


def out_of_list(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """One row: how many values repair_category changes."""
    return df.agg(F.count_if(~F.col(column).isin(allowed)).alias("changed"))
