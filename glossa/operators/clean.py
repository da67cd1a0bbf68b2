"""Normalising and dropping lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rx
from ..functions.text import normalize, strip
from ..sources.rules import Rules


def normalize_lines(lines: DataFrame, rules: Rules) -> DataFrame:
    """Normalised text; table lines stay as they are."""
    return lines.withColumn("text", F.when(F.coalesce("is_table", F.lit(False)), F.col("text")).otherwise(normalize(F.col("text"), rules.replacements)))


def marked(rules: Rules) -> Column:
    """Whether a line is a page mark or carries a header or footer signature."""
    return reduce(lambda a, s: a | F.contains("text", F.lit(s)), rules.signatures, rx.starts(F.col("text"), rx.PAGE_MARK))


def drop_marked(lines: DataFrame, rules: Rules) -> DataFrame:
    return lines.where(~marked(rules))


def drop_repeated(lines: DataFrame, but: Column | None = None) -> DataFrame:
    """Without short lines that stand at the same height on at least two, and half, of a document's pages.

    Lines are counted, not pages.  Both counts are windows over one exchange on the
    document, which later steps reuse; windows spill, so a long document costs
    its task a sort and no memory.  Lines without document, text or height stay.
    Lines of which ``but`` isn't false count nowhere and go.  They go after the first
    window: a filter before it would make each line's text again for every test.
    """
    columns = lines.columns
    counts = F.lit(True) if but is None else ~F.col("_but")
    lines = lines if but is None else lines.withColumn("_but", but)
    pages = F.size(F.collect_set(F.when(counts, F.col("page_num"))).over(Window.partitionBy("doc_id")))
    short = F.coalesce((F.length("text") < 80) & F.col("doc_id").isNotNull() & F.col("y0").isNotNull(), F.lit(False))
    counted = lines.withColumn("_pages", pages).where(counts).withColumn("_short", short)
    counted = counted.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "text", "y0")))
    return counted.where(~(F.col("_short") & (F.col("_n") >= F.greatest(F.lit(2.0), F.col("_pages") * 0.5)))).select(columns)


def filter_lines(lines: DataFrame, rules: Rules) -> DataFrame:
    return drop_repeated(lines, marked(rules))


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")


def in_order(lines: DataFrame) -> DataFrame:
    """pos: the place of a line in its document, by page, height, left edge and extraction order."""
    order = Window.partitionBy("doc_id").orderBy("page_num", "y0", "x0", "line_no")
    return lines.withColumn("pos", F.row_number().over(order))
