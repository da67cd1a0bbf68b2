"""Words to lines, fonts, tables to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# fixed values: points between a line's first word and another of it; the height of a line of unknown font
TOLERANCE, HEIGHT = 3.0, 12.0


def font_size(chars: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(chars, lambda c: c["size"])), F.lit(0.0))


def font_name(chars: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.transform(chars, lambda c: c["fontname"]), lambda n: n != ""), F.lit(1)), F.lit(""))


def is_bold(chars: Column) -> Column:
    return F.coalesce(F.exists(chars, lambda c: F.contains(c["fontname"], F.lit("Bold"))), F.lit(False))


def line_starts(words: Column) -> Column:
    """Places (from 0) of a page's words that begin a line; only places and one height go through the fold."""
    begin = F.struct(F.array(F.lit(0)).alias("starts"), words[0]["top"].alias("top"), F.lit(0).alias("at"))

    def step(acc: Column, w: Column) -> Column:
        breaks = (w["text"] != "") & (F.abs(w["top"] - acc["top"]) > TOLERANCE)
        starts = F.when(breaks, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"])
        return F.struct(starts.alias("starts"), F.when(breaks, w["top"]).otherwise(acc["top"]).alias("top"), (acc["at"] + 1).alias("at"))

    return F.aggregate(words, begin, step, lambda acc: acc["starts"])


def cluster_words(words: DataFrame) -> DataFrame:
    """LINES of words (doc_id, page_num, word_no, text, top, x0, x1, chars).

    A word joins the line whose first word's top is at most TOLERANCE away; blank
    words join none, but a page's first word sets the first line's height and
    edges even if it is blank.  A fold finds where lines begin, and each line is
    then a slice of the page's words.  A page bounds the size of a row.
    """
    word = F.struct("word_no", "text", "top", "x0", "x1", "chars")
    return cluster_pages(words.groupBy("doc_id", "page_num").agg(F.collect_list(word).alias("words")))


def cluster_pages(pages: DataFrame) -> DataFrame:
    """``cluster_words`` of whole pages (doc_id, page_num, words: an array of the other columns), where they are: nothing is dealt out."""
    none = F.array().cast("array<struct<size:double,fontname:string>>")
    word = lambda w: F.struct(w["word_no"].alias("word_no"), strip(w["text"]).alias("text"), w["top"].cast("double").alias("top"), w["x0"].cast("double").alias("x0"), w["x1"].cast("double").alias("x1"), F.coalesce(w["chars"].cast("array<struct<size:double,fontname:string>>"), none).alias("chars"))
    pages = pages.select("doc_id", "page_num", F.array_sort(F.transform("words", word)).alias("every")).withColumn("starts", line_starts(F.col("every")))

    def line(start: Column, i: Column) -> Column:
        part = F.slice("every", start + 1, F.coalesce(F.get("starts", i + 1), F.size("every")) - start)
        return F.struct((i == 0).alias("first"), F.get("every", start).alias("lead"), F.filter(part, lambda w: w["text"] != "").alias("own"))

    lines = F.filter(F.transform("starts", line), lambda x: F.size(x["own"]) > 0)
    found = pages.select("doc_id", "page_num", F.posexplode(lines).alias("line_no", "x")).select("doc_id", "page_num", "line_no", "x.*")
    own, chars = F.col("own"), F.flatten(F.col("own.chars"))
    edge = lambda side: F.when(F.col("first"), F.col(f"lead.{side}"))
    size = font_size(chars)
    return found.select("doc_id", F.lit(None).cast("string").alias("source_path"), "line_no", strip(F.array_join(own["text"], "")).alias("text"), "page_num", F.least(edge("x0"), F.array_min(own["x0"])).alias("x0"), F.col("lead.top").alias("y0"), F.greatest(edge("x1"), F.array_max(own["x1"])).alias("x1"), (F.col("lead.top") + F.when(size > 0, size).otherwise(HEIGHT)).alias("y1"), size.alias("font_size"), is_bold(chars).alias("bold"), font_name(chars).alias("fontname"), F.lit(False).alias("is_table"))


def table_markdown(cells: Column) -> Column:
    """A Markdown table of rows of cells, or null for fewer than two rows."""
    row = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    clean = lambda r: F.transform(r, lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")))
    rows = F.transform(cells, lambda r: row(clean(r)))
    rule = row(F.transform(F.element_at(cells, 1), lambda c: F.lit("---")))
    return F.when(F.size(cells) >= 2, F.concat_ws("\n", F.element_at(rows, 1), rule, F.array_join(F.slice(rows, 2, F.size(cells)), "\n")))


def table_lines(tables: DataFrame) -> DataFrame:
    """LINES of tables (doc_id, page_num, table_no, cells), one a table at the page's top."""
    zero = F.lit(0.0)
    rows = tables.withColumn("text", table_markdown(F.col("cells"))).where("text is not null")
    return rows.select("doc_id", F.lit(None).cast("string").alias("source_path"), (F.lit(1_000_000) + F.col("table_no")).cast("int").alias("line_no"), "text", "page_num", *(zero.alias(c) for c in ("x0", "y0", "x1", "y1", "font_size")), F.lit(False).alias("bold"), F.lit("").alias("fontname"), F.lit(True).alias("is_table"))
