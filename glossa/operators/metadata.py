"""Document metadata from the lines of the first page, in extraction order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rx
from ..functions.classify import doc_type
from ..functions.text import strip

# fixed values: shares of the largest font that make a title and an author line, and their lengths
TITLE_SHARE, TITLE_LENGTH, AUTHOR_SHARE, AUTHOR_LENGTH = 0.9, 4, 0.7, (1, 30)


def first_page(lines: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, page (its text), lines: of page 1, unsorted and unfiltered.

    Every document has a row, also one whose first page has no line, and one of
    ``docs`` (doc_id) that has no line at all; their page is empty.
    """
    own = F.when(F.col("page_num") == 1, F.struct("line_no", "text", F.coalesce("font_size", F.lit(0.0)).alias("font_size")))
    rows = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(own)).alias("lines"))
    if docs is not None:
        rows = docs.select("doc_id").distinct().join(rows.hint("merge"), "doc_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast(rows.schema["lines"].dataType)))
    return rows.withColumn("page", F.array_join("lines.text", "\n"))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return strip(rx.first(text, pattern, group))


def extract(pages: DataFrame, source: str | None = None) -> DataFrame:
    """name, doc_no, dates, authority, doc_type and the extra values of judgments and books."""
    page = F.col("page")
    sizes = F.filter(F.col("lines"), lambda x: x["font_size"] > 0)
    rows = pages.withColumn("doc_type", doc_type(page)).withColumn("largest", F.coalesce(F.array_max(F.transform(sizes, lambda x: x["font_size"])), F.lit(0.0))).withColumn("dates", F.transform(rx.every(page, rx.DATE), strip))
    line = lambda test: F.coalesce(F.try_element_at(F.filter(F.col("lines"), test), F.lit(1))["text"], F.lit(""))
    name = line(lambda x: (x["font_size"] > 0) & (x["font_size"] >= F.col("largest") * TITLE_SHARE) & (F.length(x["text"]) > TITLE_LENGTH))
    author = line(
        lambda x: (x["font_size"] > 0) & (x["font_size"] >= F.col("largest") * AUTHOR_SHARE) & (x["font_size"] < F.col("largest")) & (F.length(x["text"]) > AUTHOR_LENGTH[0]) & (F.length(x["text"]) < AUTHOR_LENGTH[1]) & ~rx.has(x["text"], rx.PUBLISHER) & ~rx.has(x["text"], rx.ISBN)
    )
    date = lambda i: F.coalesce(F.try_element_at("dates", F.lit(i)), F.lit(""))
    title = lambda g: F.regexp_extract(page, rx.anchored(rx.JUDGMENT_TITLE), g)
    judged, book = F.col("doc_type") == "judgment", F.col("doc_type") == "book"
    only = lambda on, value: F.when(on, F.nullif(value, F.lit("")))
    extras = {
        "case_number": only(judged, found(page, rx.CASE_NUMBER)),
        "court": only(judged, title(2)),
        "judgment_type": only(judged, F.concat(title(3), title(4))),
        "judgment_date": only(judged, date(-1)),
        "isbn": only(book, found(page, rx.ISBN)),
        "publisher": only(book, found(page, rx.PUBLISHER)),
        "author": only(book, author),
        "publish_date": only(book, date(-1)),
    }
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in extras.items())), lambda e: e["value"].isNotNull())
    return rows.select("doc_id", name.alias("name"), found(page, rx.DOC_NUMBER).alias("doc_no"), date(1).alias("publish_date"), date(2).alias("effective_date"), found(page, rx.AUTHORITY).alias("issuing_authority"), F.lit(source or "").alias("source_pdf"), "doc_type", F.map_from_entries(entries).alias("extra"))


def metadata(lines: DataFrame, source: str | None = None, docs: DataFrame | None = None) -> DataFrame:
    return extract(first_page(lines, docs), source)


def with_preamble(meta: DataFrame, preambles: DataFrame) -> DataFrame:
    """Documents' metadata, with the lines before the first node as an extra value."""
    entry = F.when(F.col("preamble").isNotNull(), F.create_map(F.lit("preamble"), F.col("preamble"))).otherwise(F.create_map().cast("map<string,string>"))
    return meta.join(preambles.hint("merge"), "doc_id", "left").withColumn("extra", F.map_concat("extra", entry)).drop("preamble")
