"""Result tables in web pages: a main row with up to two detail rows after it becomes one record."""

from __future__ import annotations

from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.tables import Row, table_rows
from rillflow.functions.text import null_if_empty

#: The class of detail rows, and patterns of the tags in them.
DETAIL_CLASS = "tw-border-none"
TAGS = {
    "status": r"(Accepted|Rejected|Wait listed|Interview)",
    "decision date": r"on (.+)$",
    "degree": r"(PhD|Other)",
    "GRE score": r"^GRE (\d+)$",
    "GRE V score": r"^GRE V (\d+)$",
    "GPA": r"^GPA ([\d.]+)$",
    "GRE AW": r"^GRE AW ([\d.]+)$",
}


def tag(c: Column, name: str) -> Column:
    """What a tag's pattern matches (of a decision date: what follows 'on '); null where it does not."""
    return null_if_empty(F.regexp_extract(c, TAGS[name], 1 if name == "decision date" else 0))


def decoded(c: Column) -> Column:
    """Text without markup, the usual character references decoded, white space collapsed."""
    out = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: Pages whose rows are held at once.
PAGES_AT_ONCE = 100
ROWS = "array<struct<cls:string,cells:array<struct<text:string,spans:array<string>,href:string>>,divs:array<string>,text:string>>"


def _listed(lists: list, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), values)


def arrays(pages: list[list[Row]]) -> pa.ListArray:
    """The rows of some pages as one column of type ROWS, made level by level."""
    rows = list(chain.from_iterable(pages))
    cells = list(chain.from_iterable(r.cells for r in rows))
    spans, divs = [c.spans for c in cells], [r.divs for r in rows]
    text = lambda values: pa.array(values, pa.string())
    cell = pa.StructArray.from_arrays([text([c.text for c in cells]), _listed(spans, text(list(chain.from_iterable(spans)))), text([c.href for c in cells])], ["text", "spans", "href"])
    row = [text([r.cls for r in rows]), _listed([r.cells for r in rows], cell), _listed(divs, text(list(chain.from_iterable(divs)))), text([r.text for r in rows])]
    return _listed(pages, pa.StructArray.from_arrays(row, ["cls", "cells", "divs", "text"]))


def rows_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, rows): all table rows of each page in order. No shuffle."""

    def read(batches):
        for b in batches:
            for at in range(0, b.num_rows, PAGES_AT_ONCE):
                some = b.slice(at, PAGES_AT_ONCE)
                rows = arrays([table_rows(h or "") for h in some.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), rows], ["page_id", "url", "rows"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(read, f"page_id {kind}, url string, rows {ROWS}")


def grouped(rows: DataFrame) -> DataFrame:
    """(page_id, url, pos, head, tags, note, n_details): a row without class begins a record and detail rows after it belong to it; other
    rows end it and go. Within the page's array: rows that are no details are numbered, and what lies up to the next one are details."""
    detail = lambda r: F.coalesce(F.array_contains(F.split(r["cls"], r"\s+"), DETAIL_CLASS), F.lit(False))
    ends = F.filter(F.transform("rows", lambda r, i: F.when(~detail(r), i)), lambda i: i.isNotNull())
    marked = rows.withColumn("ends", F.concat(ends, F.array(F.size("rows"))))
    at = lambda i: F.get("rows", i)
    made = F.transform(
        F.slice("ends", F.lit(1), F.size("ends") - 1),
        lambda i, k: F.struct(i.alias("pos"), at(i).alias("head"), F.when(F.get("ends", k + 1) > i + 1, at(i + 1)).alias("tags"), F.when(F.get("ends", k + 1) > i + 2, at(i + 2)).alias("note"), (F.get("ends", k + 1) - i - 1).alias("n_details")),
    )
    return marked.select("page_id", "url", F.inline(F.filter(made, lambda x: x["head"]["cls"].isNull())))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record for each main row, and n_details; rows without details are rejects (n_details = 0). No shuffle."""
    r = grouped(rows_of(pages, id_col, url_col, html_col))
    cell = lambda i: F.get(F.col("head.cells"), F.lit(i))
    status_text = cell(3)["text"]
    status, decision = tag(status_text, "status"), tag(status_text, "decision date")
    status = F.when(status.isin("Accepted", "Rejected") & decision.isNotNull(), F.concat(status, F.lit(" on "), decision)).otherwise(status)
    # The tags are the innermost div elements of the first detail row; a column of their own, so that they are sorted out once a record.
    tags = F.col("__tags")
    r = r.withColumn("__tags", F.filter(F.coalesce(F.col("tags.divs"), F.array().cast("array<string>")), lambda x: (x != "") & ~x.rlike(TAGS["status"])))
    last = lambda name: null_if_empty(F.regexp_extract(F.coalesce(F.try_element_at(F.filter(tags, lambda x: x.rlike(TAGS[name])), F.lit(-1)), F.lit("")), TAGS[name], 0))
    span = lambda i: F.coalesce(F.get(cell(1)["spans"], F.lit(i)), F.lit(""))
    return r.select(
        "page_id",
        "pos",
        F.concat(span(0), F.lit(", "), cell(0)["text"]).alias("program"),
        F.when(F.col("n_details") == 2, F.col("note.text")).alias("comments"),
        cell(2)["text"].alias("date_added"),
        absolute(F.coalesce(cell(4)["href"], F.lit("")), F.col("url")).alias("url"),
        status.alias("status"),
        F.get(tags, F.lit(0)).alias("term"),
        F.get(tags, F.lit(1)).alias("us_or_international"),
        last("GPA").alias("gpa"),
        last("GRE score").alias("gre"),
        last("GRE V score").alias("gre_v"),
        last("GRE AW").alias("gre_aw"),
        F.coalesce(tag(span(1), "degree"), F.lit("Masters")).alias("degree"),
        "n_details",
    )


def raw_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The records that have details under the names of raw results, as `validate.converted` reads them, with page_id and pos."""
    named = {"date_added": "date added", "us_or_international": "US/International", "gpa": "GPA", "gre": "GRE score", "gre_v": "GRE V score", "gre_aw": "GRE AW"}
    found = records(pages, id_col, url_col, html_col).filter("n_details > 0").drop("n_details")
    found = found.withColumn("date_added", F.concat(F.lit("Added on "), F.col("date_added")))
    return found.withColumnsRenamed(named).withColumns({c: F.lit(None).cast("string") for c in ("llm-generated-program", "llm-generated-university")})


def absolute(link: Column, url: Column) -> Column:
    """A link's target as seen from a page: whole urls stay, others are resolved against the page's host, folder or path (RFC 3986)."""
    host, scheme = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page, path = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"^(.*/)", 1)).otherwise("/")
    way, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    full = F.when(way.startswith("/"), way).otherwise(F.concat(folder, way))
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | (host == ""), link)
        .when(link == "", url)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(url, r"^([^#]*)", 1), link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(host, F.when(full.contains("/."), without_dots(full)).otherwise(full), rest))
    )


def without_dots(path: Column) -> Column:
    """A path that starts with "/" without its "." and ".." segments."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")) - 1)
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    left = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(left, "/"), F.when((F.size(left) > 0) & path.rlike(r"/\.{1,2}$"), "/").otherwise(""))


def page_titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", decoded(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): targets of all links in order, relative ones resolved against the page."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?\shref=\"([^\"]*)\""), F.lit(1))).alias("pos", "link")
    return pages.select("page_id", "url", found).select("page_id", "pos", absolute(F.col("link"), F.col("url")).alias("link"))
