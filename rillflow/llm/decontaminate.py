"""Benchmark decontamination by template canonicalisation, with built-in DataFrame functions only.

Numbers, names and units become typed placeholders, so an item and a re-parameterised copy of it give the same template.
Windows of five template words are hash-joined between documents and items; a document is flagged for an item when it
holds at least 0.8 of the item's windows and its slots are filled consistently: wherever the item repeats a value, the
document repeats the value that it puts in its place.

Items are indexed with and without name slots, so a copy in other letter case matches too. A document and item that fail this test by
their whole texts (the rule of the SQL) pass when one occurrence passes: windows keep their positions, hits are grouped by the offset between
document and item, and slots are compared inside one group. For this, white space is one space before names are marked, documents are
windowed with and without name slots where these differ, and an item's first word may be a name or none. Document windows are made row by row
and meet the items' windows in a broadcast hash join while these are few (checked), else in a shuffled join; only hits are shuffled.

Defined cases: null and empty texts match nothing; items of fewer words than a window match word for word; repeated items are
reported each; rows of one doc_id are judged together, null ids as one document, but by `clean_rows` each row by its own text; repeated passages count once; empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import counted, stored

#: Items' windows are broadcast up to this many (about 40 bytes each).
BROADCAST_WINDOWS = 200_000
WORDS, SIMILARITY = 5, 0.8
#: Words that are units when a number stands before them.
UNITS = "kilograms?|kg|grams?|g|mg|pounds?|lbs?|oz|kilomet(?:er|re)s?|km|met(?:er|re)s?|m|cm|mm|miles?|mi|feet|foot|ft|inch(?:es)?|hours?|hrs?|h|minutes?|mins?|min|seconds?|sec|s|days?|weeks?|months?|years?|dollars?|usd|euros?|eur|cents?|percent|lit(?:er|re)s?|l|ml"
NAME, UNIT = "¤", "¦"
#: Forms of an item: 0 and 1 with and without name slots, as the SQL has them; then with single spaces: 2 and 3 with name slots, its first word none or one, 4 without.
FORMS = 5
#: The document's form that each of them meets: 0 as it is, 1 with single spaces, 2 also without name slots.
MEETS = (0, 0, 1, 1, 2)
#: Offsets within this share of an item's windows are one occurrence.
SLACK = 0.25


def marked(text: Column, names: bool = True) -> Column:
    """Lower-case text; a name (a capitalised word inside a sentence) and a unit after a number carry a mark before them."""
    text = F.coalesce(text, F.lit(""))
    if names:
        text = F.regexp_replace(text, "([a-z0-9,;] )([A-Z][a-z])", f"$1{NAME}$2")
    return F.regexp_replace(F.lower(text), rf"([0-9] ?)((?:{UNITS})(?:[^0-9a-z]|\z))", f"$1{UNIT}$2")


def slotted(text: Column, names: bool = True) -> Column:
    """array<string>: the words of a marked text."""
    return F.regexp_extract_all(marked(text, names), F.lit(r"([0-9a-z\x{80}-\x{10FFFF}]+)"), F.lit(1))


def placeholder(word: Column) -> Column:
    return F.when(word.startswith(NAME), NAME).when(word.startswith(UNIT), UNIT).when(word.rlike("^[0-9]"), "0").otherwise(word)


def windows(words: Column, length: int = WORDS) -> Column:
    """array<struct<at, key, slots>> of a words column: the template's hash of each window, and the window's words where it has slots.

    For items and the few documents whose slots are compared; whole corpora go through `templates`.
    """
    n = F.size(words)

    def one(i: Column) -> Column:
        template = [placeholder(F.get(words, i + k)) for k in range(length)]
        has_slot = F.exists(F.slice(words, i + 1, length), lambda w: w.rlike(f"^[0-9{NAME}{UNIT}]"))
        return F.struct(i.alias("at"), F.xxhash64(F.concat_ws(" ", *template)).alias("key"), F.when(has_slot, F.slice(words, i + 1, length)).alias("slots"))

    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), one))


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def item_words(text: Column, form: int) -> Column:
    if form < 2:
        return slotted(text, form == 0)
    if form == 3:  # as after a word in lower case
        words = slotted(F.concat(F.lit("a "), single_spaced(text)))
        return F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return slotted(single_spaced(text), form == 2)


def document_words(text: Column, meets: int) -> Column:
    return slotted(text if meets == 0 else single_spaced(text), meets < 2)


def met_windows(text: Column, length: int) -> Column:
    """array<struct<meets, t>>: a document's templates in each of its forms; -1 where all forms are the same."""
    differ = F.coalesce(text, F.lit("")).rlike(r"[a-z0-9,;]\s+[A-Z][a-z]|[0-9](?:\s\s|[^\S ])")

    def of(meets: int, found: Column) -> Column:
        return F.transform(found, lambda t: F.struct(F.lit(meets).alias("meets"), t.alias("t")))

    # The second form differs from the first only where a name or a unit follows white space that is no single space.
    spaced = F.coalesce(text, F.lit("")).rlike(r"[a-z0-9,;](?:\s\s+|[^\S ])[A-Z][a-z]|[0-9](?:\s\s|[^\S ])")
    third = of(2, templates(single_spaced(text), length, False))

    def forms(first: Column) -> Column:
        second = F.when(spaced, templates(single_spaced(text), length)).otherwise(first)
        return F.concat(of(0, first), of(1, second), third)

    # a list of one list binds the first form, so that it is made once
    return F.when(differ, F.flatten(F.transform(F.array(templates(text, length)), forms))).otherwise(of(-1, templates(text, length)))


def templates(text: Column, length: int = WORDS, names: bool = True) -> Column:
    """array<string>: all windows of a text's template, as one regular expression finds them: each match looks ahead over a window
    and moves on by one word."""
    spaced = F.trim(F.regexp_replace(marked(text, names), r"[^0-9a-z\x{80}-\x{10FFFF}]+", " "))
    typed = F.regexp_replace(F.regexp_replace(spaced, "(?<![^ ])[0-9][^ ]*", "0"), f"(?<![^ ])([{NAME}{UNIT}])[^ ]*", "$1")
    spaced = F.when(spaced.rlike(f"[0-9{NAME}{UNIT}]"), typed).otherwise(spaced)
    window = " ".join(["[^ ]++"] * length)
    return F.regexp_extract_all(spaced, F.lit(f"(?=({window}))[^ ]++"), F.lit(1))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = WORDS, similarity: float = SIMILARITY, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, n_windows, n_matched, containment, n_slots, n_changed."""
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.lit(MEETS[k]).alias("meets"), item_words(F.col(item_text_col), k).alias("words")) for k in range(FORMS)])).alias("f")
    items = benchmark.select(F.col(item_col).alias("item_id"), forms).select("item_id", "f.form", "f.meets", F.explode(windows(F.col("f.words"), length)).alias("w"))
    items = items.select("item_id", "form", "meets", F.col("w.at").alias("item_at"), F.col("w.key").alias("key"), F.col("w.slots").alias("item_slots"))
    known = items.agg(F.count("*").alias("n"), F.count("item_slots").alias("slots")).first()
    sizes = items.groupBy("item_id", "form").agg(F.countDistinct("key").alias("n_windows"), F.countDistinct("item_at").alias("n_at"))
    small = F.broadcast if known["n"] <= broadcast_windows else (lambda df: df)
    held = docs.select(F.col(id_col).alias("doc_id"), F.explode(met_windows(F.col(text_col), length)).alias("w")).select("doc_id", F.col("w.meets").alias("met"), F.xxhash64("w.t").alias("key"))
    held = held.join(small(items.select("item_id", "form", "meets", "key").distinct()), "key").filter("met in (-1, meets)")
    # An item's windows bound each group, and repeats go before the shuffle.
    held = held.groupBy("doc_id", "item_id", "form").agg(F.countDistinct("key").alias("n_matched")).join(small(sizes), ["item_id", "form"])
    held = stored(held.withColumn("containment", F.col("n_matched") / F.col("n_windows")).filter(F.col("containment") >= similarity))
    whole = held.filter("form < 2").drop("n_at")
    if known["slots"]:
        whole = _consistent(whole, docs, items.filter("form < 2"), small, id_col, text_col, length)
    else:
        whole = whole.withColumns({"n_slots": F.lit(0), "n_changed": F.lit(0)})
    whole = stored(_best(whole))
    other = held.join(whole.select(F.col("doc_id").alias("__doc"), F.col("item_id").alias("__item")), F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("item_id").eqNullSafe(F.col("__item")), "left_anti")
    found = whole.unionByName(_best(_aligned(other, docs, items, small, id_col, text_col, length, similarity)))
    short = _short(docs, benchmark, id_col, text_col, item_col, item_text_col, length)
    return found if short is None else found.unionByName(short)


def _best(held: DataFrame) -> DataFrame:
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_matched", "n_windows", "n_slots", "n_changed")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", "b.n_matched", "b.containment", F.col("b.n_slots").cast("long").alias("n_slots"), F.col("b.n_changed").cast("long").alias("n_changed"))


def _aligned(held: DataFrame, docs: DataFrame, items: DataFrame, small, id_col: str, text_col: str, length: int, similarity: float) -> DataFrame:
    """held's rows of which one occurrence in one document row holds the item, with the occurrence's counts.

    An occurrence is an offset with the hits near it. Of each item window it takes the hit at the offset itself, or the nearest one, or one
    with the item's own words; each choice is tried. Windows of nothing but slots count only with the item's own words.
    """
    again = counted(held.select(F.col("doc_id").alias("__id")).distinct())
    some = docs.join(again, docs[id_col].eqNullSafe(again["__id"]), "left_semi")
    forms = F.explode(F.array(*[F.struct(F.lit(m).alias("meets"), document_words(F.col(text_col), m).alias("words")) for m in range(3)])).alias("f")
    some = some.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), forms).select("doc_id", "row", "f.meets", F.explode(windows(F.col("f.words"), length)).alias("w"))
    some = some.select("doc_id", "row", "meets", F.col("w.at").alias("doc_at"), F.col("w.key").alias("key"), F.col("w.slots").alias("slots")).distinct()
    hits = some.join(small(items), ["key", "meets"])
    asked = held.select(F.col("doc_id").alias("__doc"), F.col("item_id").alias("__item"), F.col("form").alias("__form"), "n_windows", "n_at")
    hits = hits.join(asked, hits["doc_id"].eqNullSafe(asked["__doc"]) & hits["item_id"].eqNullSafe(asked["__item"]) & (hits["form"] == asked["__form"])).drop("__doc", "__item", "__form")
    is_slot = f"^[0-9{NAME}{UNIT}]"
    hits = hits.withColumn("same", F.col("item_slots").eqNullSafe(F.col("slots"))).filter(F.col("same") | F.exists("item_slots", lambda w: ~w.rlike(is_slot)))
    pairs = F.transform(F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"].rlike(is_slot)), lambda p: F.struct(p["item_slots"].alias("of"), p["slots"].alias("to")))
    slack, offset = F.ceil(F.col("n_at") * SLACK).cast("int"), F.col("doc_at") - F.col("item_at")
    hits = hits.withColumn("pairs", F.coalesce(pairs, F.array().cast("array<struct<of:string,to:string>>"))).withColumn("offset", offset).withColumn("start", F.explode(F.sequence(offset - slack, offset + slack)))
    hits = hits.withColumn("far", F.abs(F.col("offset") - F.col("start")))
    ways = F.array(F.when(F.col("far") == 0, "exact"), F.lit("near"), F.when(F.col("same"), "same"))
    hits = hits.withColumn("way", F.explode(F.array_compact(ways)))
    which = ["doc_id", "row", "item_id", "form", "n_windows", "n_at", "start", "way"]
    taken = hits.groupBy(*which, "item_at").agg(F.min(F.struct("far", "offset", "key", "pairs")).alias("h"))
    found = taken.groupBy(*which).agg(F.count("*").alias("n_held"), F.countDistinct("h.key").alias("n_matched"), F.array_distinct(F.flatten(F.collect_list("h.pairs"))).alias("pairs"))
    found = found.withColumns({"containment": F.col("n_matched") / F.col("n_windows"), "n_slots": F.size(F.array_distinct(F.col("pairs.of"))), "n_changed": F.size(F.filter("pairs", lambda p: p["of"] != p["to"]))})
    return found.filter((F.col("containment") >= similarity) & (F.col("n_held") >= similarity * F.col("n_at")) & (F.size("pairs") == F.col("n_slots")))


def _short(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, length: int) -> DataFrame | None:
    """Documents that hold all words of an item shorter than a window, one after another, in any letter case."""
    items = benchmark.select(F.col(item_col).alias("item_id"), item_words(F.col(item_text_col), 4).alias("words")).withColumn("n", F.size("words")).filter((F.col("n") > 0) & (F.col("n") < length))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())
    if not lengths:
        return None
    slots = F.size(F.array_distinct(F.filter("words", lambda w: w.rlike(f"^[0-9{NAME}{UNIT}]"))))
    items = items.select("item_id", "n", F.concat_ws(" ", "words").alias("t"), slots.cast("long").alias("n_slots"))
    words = F.col("words")

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", F.slice(words, i + 1, n)))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

    each = [runs(n) for n in lengths]
    # Exploded, so that the words are made once and not for each window.
    held = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(document_words(F.col(text_col), 2))).alias("words")).select("doc_id", F.explode(F.array_distinct(F.concat(*each))).alias("t"))
    held = held.join(items, "t").select("doc_id", "item_id", "n_slots").distinct()
    one = F.lit(1).cast("long")
    return held.select("doc_id", "item_id", one.alias("n_windows"), one.alias("n_matched"), F.lit(1.0).alias("containment"), "n_slots", F.lit(0).cast("long").alias("n_changed"))


def _consistent(held: DataFrame, docs: DataFrame, items: DataFrame, small, id_col: str, text_col: str, length: int) -> DataFrame:
    """held's rows with n_slots and n_changed, without those where an item's value stands for several values of the document.

    Only documents that hold an item with slots are looked at again.
    """
    slots = items.filter("item_slots is not null")
    again = counted(held.join(small(slots.select("item_id", "form").distinct()), ["item_id", "form"], "left_semi").select(F.col("doc_id").alias("__id")).distinct())
    some = docs.join(again, docs[id_col].eqNullSafe(again["__id"]), "left_semi").select(F.col(id_col).alias("doc_id"), slotted(F.col(text_col)).alias("words"))
    some = some.select("doc_id", F.explode(windows(F.col("words"), length)).alias("w")).select("doc_id", F.col("w.key").alias("key"), F.col("w.slots").alias("slots"))
    # Slot pairs (item's value, document's value) of each window that both have.
    slot = F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"].rlike(f"^[0-9{NAME}{UNIT}]"))
    pairs = some.filter("slots is not null").join(small(slots), "key").select("doc_id", "item_id", "form", F.explode(F.transform(slot, lambda p: F.struct(p["item_slots"].alias("of"), p["slots"].alias("to")))).alias("p"))
    pairs = pairs.groupBy("doc_id", "item_id", "form").agg(F.countDistinct("p.of").alias("n_slots"), F.countDistinct("p").alias("n_pairs"), F.countDistinct(F.when(F.col("p.of") != F.col("p.to"), F.col("p"))).alias("n_changed"))
    pairs = pairs.withColumnRenamed("doc_id", "__doc")
    both = held.join(pairs, held["doc_id"].eqNullSafe(pairs["__doc"]) & (held["item_id"] == pairs["item_id"]) & (held["form"] == pairs["form"]), "left")
    both = both.select(held["*"], *[F.coalesce(pairs[c], F.lit(0)).alias(c) for c in ("n_slots", "n_pairs", "n_changed")])
    return both.filter("n_pairs = n_slots").drop("n_pairs")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, in their own columns, without those that hold an item."""
    flagged = counted(stored(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__id")).distinct()))
    return docs.join(flagged, docs[id_col].eqNullSafe(flagged["__id"]), "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, in their own columns, without the rows that hold an item: each row is judged by its own text, whatever its id."""
    row = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    flagged = counted(stored(contaminated(docs.select(row.alias("__row"), F.col(text_col)), benchmark, "__row", text_col).select(F.col("doc_id").alias("__held")).distinct()))
    return docs.join(flagged, row == flagged["__held"], "left_anti")
