"""From ordered lines to structural nodes.

``annotate`` says of each line whether it opens a node (title), is a leaf of
one (sub, item, clause, footnote), belongs to its text (plain) or comes before
the first node (preamble).  For all documents but books this is a matter of
windows over the lines; a book's headings depend on the headings before them,
so books alone go through a fold in Python, one document at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, rx
from ..functions.text import article_number, strip
from .clean import drop_blank, in_order

# fixed values: points of indentation that make a clause; the size below which a line is a footnote; heading sizes against the body
CLAUSE_INDENT, FOOTNOTE_SIZE, HEADING_RATIOS = 10.0, 9.0, ((3.0, "part"), (2.0, "chapter"), (1.5, "section"))
TITLES = ("part", "chapter", "section", "article", "preface", "appendix", "subsection")
FOOTNOTE_LEVELS = ("chapter", "section", "article", "subsection", "preface", "appendix")

KEEP = ["doc_id", "pos", "text", "page_num"]


def classified(lines: DataFrame, types: DataFrame | str) -> DataFrame:
    """Lines in order with their document's type and the level that each opens."""
    return leveled(typed(lines, types))


def typed(lines: DataFrame, types: DataFrame | str) -> DataFrame:
    """Lines with their document's type (types: doc_id, doc_type, or one type of all).

    Types are not broadcast: compressed they look small, but there is one a document.
    """
    return lines.withColumn("doc_type", F.lit(types)) if isinstance(types, str) else lines.join(types.hint("merge"), "doc_id", "left").withColumn("doc_type", F.coalesce("doc_type", F.lit("unknown")))


def leveled(lines: DataFrame) -> DataFrame:
    rows = in_order(drop_blank(lines))
    own = classify.line_level(F.col("text"))
    judged = F.when(F.col("doc_type") == "judgment", classify.judgment_level(F.col("text"))).otherwise("")
    return rows.withColumn("judged", judged).withColumn("line_level", own)


def by_windows(rows: DataFrame) -> DataFrame:
    """kind, level, node_pos of each line, without a sequential rule."""
    # all windows have one order, so that lines are sorted once
    order = Window.partitionBy("doc_id").orderBy("pos")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda on, value: F.last(F.when(on, value), ignorenulls=True)
    title = (F.col("judged") != "") | F.col("line_level").isin(*TITLES)
    sub = F.col("line_level").isin("sub_clause", "item")
    rows = rows.withColumn("title", title).withColumn("sub", sub & ~title)
    started = F.coalesce(F.max(F.col("title") | F.col("sub")).over(before), F.lit(False))
    said = last(~F.col("title") & ~F.col("sub"), F.col("pos")).over(before)
    rows = rows.withColumns({"started": started, "said": said, "last_sub": last(F.col("sub"), F.col("pos")).over(upto)})
    rows = rows.withColumn("opens", F.col("title") | (F.col("sub") & ~F.col("started")))
    opened = F.when(F.col("sub"), "article").otherwise(F.when(F.col("judged") != "", F.col("judged")).otherwise(F.col("line_level")))
    rows = rows.withColumn("opened", F.when(F.col("opens"), opened))
    head = last(F.col("opens"), F.struct("pos", F.col("opened").alias("level"), F.col("sub").alias("orphan"), "x0")).over(upto)
    rows = rows.withColumn("head", head).withColumn("node_pos", F.col("head.pos"))
    indented = F.coalesce(F.col("x0") - F.col("head.x0") >= CLAUSE_INDENT, F.lit(False))
    # a clause: not the node's first text, and no sub before it in the node
    later, subs = F.coalesce(F.col("said") > F.col("node_pos"), F.lit(False)), F.coalesce(F.col("last_sub") >= F.col("node_pos"), F.lit(False))
    clause = (F.col("head.level") == "article") & ~F.col("head.orphan") & later & ~subs & indented
    kind = F.when(F.col("title"), "title").when(F.col("sub"), F.when(F.col("line_level") == "item", "item").otherwise("sub")).when(F.col("node_pos").isNull(), "preamble").when(clause, "clause").otherwise("plain")
    return rows.select(*KEEP, kind.alias("kind"), F.col("opened").alias("level"), "node_pos", F.lit(False).alias("by_font"))


BOOK_SCHEMA = "doc_id string, pos int, text string, page_num int, kind string, level string, node_pos int, by_font boolean"


def book_lines(lines: pd.DataFrame) -> Iterator[tuple]:
    """(kind, level, node_pos, by_font) of each line of one book, in order."""
    sizes = sorted(x for x in lines["font_size"] if x > 0)
    body = sizes[len(sizes) // 4] if sizes else 0.0
    level, node, base, said = None, None, None, False  # the open node: its level, place, an article's left edge, whether it has text
    for r in lines.itertuples():
        ratio = r.font_size / body if body > 0 and r.font_size == r.font_size else 0.0
        heading = next((name for least, name in HEADING_RATIOS if ratio > least), None)
        if r.line_level in TITLES:
            level, node, said = r.line_level, r.pos, False
            base = r.x0 if level == "article" else None
            yield "title", level, node, False
        elif r.line_level in ("sub_clause", "item"):
            opened = None
            if node is None:
                level, node, said, opened = "article", r.pos, False, "article"
            base = None
            yield ("item" if r.line_level == "item" else "sub"), opened, node, False
        elif node is not None and level == "article" and base is not None and r.x0 - base >= CLAUSE_INDENT and said:
            yield "clause", None, node, False
        elif node is not None and r.is_table:
            said = True
            yield "plain", None, node, False
        elif node is not None and (r.mark or (0 < r.font_size < FOOTNOTE_SIZE and level in FOOTNOTE_LEVELS)):
            yield "footnote", None, node, False
        elif heading:
            level, node, base, said = heading, r.pos, None, False
            yield "title", level, node, True
        elif node is None:
            yield "preamble", None, None, False
        else:
            said = True
            yield "plain", None, node, False


def fold_book(lines: pd.DataFrame) -> pd.DataFrame:
    lines = lines.sort_values("pos")
    found = pd.DataFrame(list(book_lines(lines)), columns=["kind", "level", "node_pos", "by_font"], index=lines.index)
    found["node_pos"] = found["node_pos"].astype("Int32")
    return pd.concat([lines[KEEP], found], axis=1)


def annotate(lines: DataFrame, types: DataFrame, cleaned: Callable[[DataFrame], DataFrame] = lambda lines: lines, books: bool = True) -> DataFrame:
    """Lines, cleaned document by document, with what each is; without ``books`` none is of a book.

    Books are told apart before anything is cleaned or sorted, so that each line is cleaned once.
    """
    rows = typed(lines, types)
    others = by_windows(leveled(cleaned(rows.where("doc_type <> 'book'"))))
    if not books:
        return others
    rows = leveled(cleaned(rows.where("doc_type = 'book'")))
    rows = rows.select(*KEEP, "x0", F.coalesce("font_size", F.lit(0.0)).alias("font_size"), F.coalesce("is_table", F.lit(False)).alias("is_table"), "line_level", rx.starts(F.col("text"), rx.FOOTNOTE).alias("mark"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    folded = rows.groupBy("doc_id").applyInPandas(fold_book, BOOK_SCHEMA.replace("doc_id string", f"doc_id {kind}"))
    return others.unionByName(folded)


LEAVES = ("sub", "item", "clause", "footnote")


def nodes_of(annotated: DataFrame) -> DataFrame:
    """A row per structural node, with its text and its leaves in order."""
    is_leaf = F.col("kind").isin(*LEAVES)
    titled = F.col("kind").isin("sub", "item")
    head = F.max(F.when(F.col("level").isNotNull(), F.struct("level", F.when(titled, F.lit("")).otherwise(F.col("text")).alias("title"), "page_num", "by_font")))
    body = F.sort_array(F.collect_list(F.when(F.col("kind") == "plain", F.struct("pos", "text"))))
    leaf = F.struct("pos", F.col("kind").alias("level"), F.when(titled, F.col("text")).otherwise("").alias("title"), "text", "page_num")
    rows = annotated.where("node_pos is not null").groupBy("doc_id", "node_pos").agg(head.alias("h"), body.alias("body"), F.sort_array(F.collect_list(F.when(is_leaf, leaf))).alias("leaves"))
    number = F.when(F.col("h.level") == "article", article_number(F.col("h.title"))).otherwise("")
    return rows.select("doc_id", "node_pos", F.col("h.level").alias("level"), number.alias("number"), F.col("h.title").alias("title"), strip(F.array_join("body.text", "\n")).alias("text"), F.col("h.page_num").alias("page_num"), F.col("h.by_font").alias("by_font"), "leaves")


def preambles(annotated: DataFrame) -> DataFrame:
    """doc_id, preamble: the lines before the first node."""
    lines = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return annotated.where("kind = 'preamble'").groupBy("doc_id").agg(lines.alias("lines")).select("doc_id", F.array_join("lines.text", "\n").alias("preamble"))


