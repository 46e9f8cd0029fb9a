"""Standardising free-text names: split, spelling rules, reference lists, fuzzy matches, enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions.similarity import ratios
from rillflow.functions.text import null_if_empty, title_case

#: Abbreviations (whole names, any letter case, first hit wins) and spelling fixes.
ABBREVIATIONS = {r"mcg(\.|ill)?": "McGill University", r"ubc|u\.?b\.?c\.?": "University of British Columbia", r"uoft": "University of Toronto"}
UNIVERSITY_FIXES = {"McGiill University": "McGill University", "Mcgill University": "McGill University", "University Of British Columbia": "University of British Columbia"}
PROGRAM_FIXES = {"Mathematic": "Mathematics", "Info Studies": "Information Studies"}
#: Least similarity of a fuzzy match.
PROGRAM_CUTOFF, UNIVERSITY_CUTOFF = 0.84, 0.86


def split_name(c: Column, missing: str = "") -> tuple[Column, Column]:
    """(program, university): the first two parts between commas, ' at ' and ' @ ', in title case."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r",| at | @ "), lambda x: F.trim(x))
    parts = F.filter(parts, lambda x: x != "")
    university = F.coalesce(lower_of(title_case(F.get(parts, F.lit(1)))), F.lit(missing))
    return F.coalesce(title_case(F.get(parts, F.lit(0))), F.lit("")), university


def lower_of(c: Column) -> Column:
    return F.regexp_replace(c, r"\bOf\b", "of")


def expanded(c: Column, abbreviations: dict[str, str] | None = None) -> Column:
    out = c
    for pattern, full in reversed((abbreviations or ABBREVIATIONS).items()):
        out = F.when(c.rlike(rf"(?i)\A(?:{pattern})\z"), full).otherwise(out)
    return out


def fixed(c: Column, fixes: dict[str, str]) -> Column:
    out = c
    for wrong, right in fixes.items():
        out = F.when(c == wrong, right).otherwise(out)
    return out


#: Letters from rare to common, as in English text; characters that are not listed are rarer.
RARITY = "zqxjkvbpygfwmucldrhsnioate "


def characters(c: Column) -> Column:
    """array<struct<rank, again, char>>: each character of a text with the number of the same before it, rare ones first; all distinct."""
    every = F.filter(F.split(c, ""), lambda x: x != "")
    numbered = F.transform(every, lambda x, i: F.struct(F.instr(F.lit(RARITY), x).alias("rank"), (-F.size(F.filter(F.slice(every, F.lit(1), i), lambda y: y == x))).alias("again"), x.alias("char")))
    return F.array_sort(numbered)


def lookup_map(names: DataFrame, name: str = "name", line: str = "line") -> DataFrame:
    """(k, canonical): lower-case key of each name; of names with one key the last line wins."""
    return names.groupBy(F.lower(name).alias("k")).agg(F.max_by(name, line).alias("canonical"))


def fuzzy_matches(names: DataFrame, canon: DataFrame, cutoff: float, scorer: str = "ratio") -> DataFrame:
    """(name, canonical, score): the best match of each distinct name with at least `cutoff`; ties go to the later in the alphabet.

    names: column name; canon: columns k, canonical. Both scores bound the characters that two names share, so a name and a candidate
    meet by one of their rarest characters and by a length at which the cutoff can be reached; pairs that share too few
    characters go before they are scored. `ratio` is the Ratcliff-Obershelp score (whole Arrow batches of what is left at once);
    `levenshtein` is 1 - distance / longer length (built in).
    """
    n = names.select("name", F.lower("name").alias("a")).filter(F.col("a") != "").distinct().withColumn("n", F.length("a"))
    if scorer == "ratio":
        low, high = F.ceil(F.col("n") * cutoff / (2 - cutoff) - 1e-9), F.floor(F.col("n") * (2 - cutoff) / cutoff + 1e-9)
        least, shared = lambda size: F.ceil(size * cutoff / (2 - cutoff) - 1e-9), F.ceil((F.col("n") + F.col("m")) * cutoff / 2 - 1e-9)
    else:
        low, high = F.ceil(F.col("n") * cutoff - 1e-9), F.floor(F.col("n") / cutoff + 1e-9)
        least, shared = lambda size: F.ceil(size * cutoff - 1e-9), F.ceil(F.greatest("n", "m") * cutoff - 1e-9)
    n = n.withColumn("tokens", characters(F.col("a")))
    n = n.select("*", F.explode(F.slice("tokens", F.lit(1), (F.col("n") - least(F.col("n")) + 1).cast("int"))).alias("token"))
    n = n.withColumn("m", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    c = canon.filter(F.length("k") > 0).select("k", "canonical", F.length("k").alias("m"), characters(F.col("k")).alias("others"))
    c = c.select("*", F.explode(F.slice("others", F.lit(1), (F.col("m") - least(F.col("m")) + 1).cast("int"))).alias("token"))
    pairs = n.join(c, ["m", "token"]).filter(F.size(F.array_intersect("tokens", "others")) >= shared)
    pairs = pairs.select("name", "a", "n", "m", "k", "canonical").distinct()
    if scorer == "ratio":

        @F.pandas_udf("double")
        def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(ratios(b.tolist(), a.tolist()))  # the wanted name is the second text

        score = ratio("a", "k")
    else:
        score = 1 - F.levenshtein("a", "k") / F.greatest("n", "m")
    scored = pairs.withColumn("score", score).filter(F.col("score") >= cutoff)
    return scored.groupBy("name").agg(F.max(F.struct("score", "k", "canonical")).alias("b")).select("name", F.col("b.canonical").alias("canonical"), F.col("b.score").alias("score"))


def standardised(df: DataFrame, column: str, canon: DataFrame, kind: str, scorer: str = "ratio", out: str = "standard") -> DataFrame:
    """df plus the standard form of a column: rules, exact look-up, fuzzy look-up of distinct unmatched names, else as the rules leave it."""
    c = F.trim(F.coalesce(F.col(column), F.lit("")))
    if kind == "program":
        rule, cutoff = title_case(fixed(c, PROGRAM_FIXES)), PROGRAM_CUTOFF
    else:
        rule, cutoff = lower_of(title_case(fixed(expanded(c), UNIVERSITY_FIXES))), UNIVERSITY_CUTOFF
    distinct = df.select(F.col(column).alias("__raw"), rule.alias("name")).distinct()
    exact = distinct.join(canon, F.lower("name") == F.col("k"), "left").drop("k")
    fuzzy = fuzzy_matches(exact.filter("canonical is null").select("name"), canon, cutoff, scorer).select("name", F.col("canonical").alias("near"))
    named = exact.join(fuzzy, "name", "left").select("__raw", F.coalesce("canonical", "near", "name").alias(out))
    return df.join(named, F.col(column).eqNullSafe(F.col("__raw"))).drop("__raw")


def unmatched_report(df: DataFrame, column: str, canon: DataFrame) -> DataFrame:
    """(name, n): names that no list entry equals, with their frequency."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return counted.join(canon, F.lower("name") == F.col("k"), "left_anti")


def parsed_output(text: Column, original: Column) -> tuple[Column, Column]:
    """(program, university) of a predictor's JSON text: its first object, closed if cut off; else the split of the original."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract(F.when(text.contains("{") & ~text.contains("}"), F.concat(text, F.lit("}"))).otherwise(text), r"(?s)\{.*?\}", 0)
    obj = F.from_json(found, "program string, university string")
    ok = (found != "") & F.coalesce(obj["program"], obj["university"]).isNotNull()
    program, university = split_name(original)
    blank = F.coalesce(null_if_empty(F.trim(university)), original)
    return F.when(ok, F.trim(F.coalesce(obj["program"], F.lit("")))).otherwise(program), F.when(ok, F.coalesce(null_if_empty(F.trim(F.coalesce(obj["university"], F.lit("")))), original)).otherwise(blank)


Predictor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def enriched(df: DataFrame, column: str, predictor: Predictor | None = None, partitions: int | None = None) -> DataFrame:
    """df plus llm_generated_program and llm_generated_university. A null name counts as empty.

    Without a predictor the name is split (built in, no shuffle). A predictor maps frames (name) to frames (name, program, university);
    each distinct name is predicted once, in `partitions` chunks if given.
    """
    named = F.coalesce(F.col(column), F.lit(""))
    if predictor is None:
        program, university = split_name(named)
        return df.withColumns({"llm_generated_program": program, "llm_generated_university": university})
    marked = df.withColumn("__name", named)
    names = marked.select(F.col("__name").alias("name")).distinct()
    names = names.repartition(partitions) if partitions else names
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "program", "university")])
    got = names.mapInPandas(predictor, schema).select(F.col("name").alias("__name"), F.col("program").alias("llm_generated_program"), F.col("university").alias("llm_generated_university"))
    return marked.join(got, "__name").drop("__name")
