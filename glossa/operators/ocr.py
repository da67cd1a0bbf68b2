"""Everything around character recognition that is plain data: routing, resolution, boxes to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..schema import LINES

# fixed values: characters that make a page text; characters beyond which a page is skipped; least score; resolution; longest side in pixels; pages a batch
TEXT_CHARS, PAGE_LIMIT, MIN_SCORE, DPI, MAX_SIDE, BATCH = 10, 200_000, 0.5, 300, 4000, 5


def within_limit(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("n_chars") <= PAGE_LIMIT)


def first_pages(rows: DataFrame, max_pages: int | None) -> DataFrame:
    """Only pages up to a number; none or 0 means all, below 0 none."""
    return rows if not max_pages else rows.where(F.col("page_num") <= max_pages)


def has_text(n_chars: Column) -> Column:
    return n_chars >= TEXT_CHARS


def needs_ocr(n_chars: Column, mode: str) -> Column:
    """mode: off, auto (pages without text) or force."""
    if mode not in ("off", "auto", "force"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.lit(mode == "force") if mode != "auto" else ~has_text(n_chars)


def resolution(width_pt: Column, height_pt: Column, dpi: int = DPI, max_side: int = MAX_SIDE) -> Column:
    """The resolution at which the page's long side stays within the limit."""
    scale = F.lit(dpi / 72.0)
    side = F.greatest(F.floor(width_pt * scale), F.floor(height_pt * scale))
    return F.when(side > max_side, F.floor(F.lit(72.0) * (scale * (F.lit(float(max_side)) / side)))).otherwise(dpi).cast("int")


def box_lines(pages: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, page_num, box_no, text, x0, y0, x1, y1, font_size of recognised boxes.

    pages: doc_id, page_num, dt_polys, rec_texts, rec_scores, dpi; the shortest
    of the three arrays sets how many boxes there are.
    """
    n = F.least(F.size("dt_polys"), F.size("rec_texts"), F.size("rec_scores"))
    boxes = F.slice(F.arrays_zip("dt_polys", "rec_texts", "rec_scores"), F.lit(1), F.greatest(n, F.lit(0)))
    rows = pages.select("doc_id", "page_num", (F.lit(72.0) / F.col("dpi")).alias("scale"), F.posexplode(boxes).alias("box_no", "b")).where((strip(F.col("b.rec_texts")) != "") & (F.col("b.rec_scores") >= min_score))
    side = lambda i: F.transform(F.col("b.dt_polys"), lambda p: p[i].cast("double") * F.col("scale"))
    rows = rows.select("doc_id", "page_num", "box_no", strip(F.col("b.rec_texts")).alias("text"), F.array_min(side(0)).alias("x0"), F.array_min(side(1)).alias("y0"), F.array_max(side(0)).alias("x1"), F.array_max(side(1)).alias("y1"))
    rounded = [tenth(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return rows.select("doc_id", "page_num", "box_no", "text", *rounded, tenth(F.col("y1") - F.col("y0")).alias("font_size"))


def lines_of_boxes(pages: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """LINES of recognised pages, numbered in reading order: by height, then left edge."""
    order = Window.partitionBy("doc_id", "page_num").orderBy("y0", "x0", "box_no")
    rows = box_lines(pages, min_score).withColumn("line_no", (F.row_number().over(order) - 1).cast("int"))
    rows = rows.withColumns({"source_path": F.col("doc_id"), "bold": F.lit(False), "fontname": F.lit(""), "is_table": F.lit(False)})
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in LINES))


def tenth(value: Column) -> Column:
    """Rounded to one decimal by the exact binary value, ties to even.

    The value as an exact decimal (a double times a power of two is exact)
    decides; a decimal's own rounding would look at the shortest digits.
    """
    scaled = value * 10.0
    near = F.rint(scaled)
    # the product was rounded: take its exact error into account at a tie
    high = (value * 134217729.0) - ((value * 134217729.0) - value)
    error = ((high * 10.0) - scaled) + (value - high) * 10.0
    down, up = F.floor(scaled), F.ceil(scaled)
    tie = (scaled - down) == 0.5
    return F.when(tie & (error > 0), up).when(tie & (error < 0), down).otherwise(near).cast("double") / 10.0
