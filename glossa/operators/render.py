"""Markdown and JSON of documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..functions.text import full_text, heading_level, law_references, reference_link
from .tree import leaf_path


def yaml_scalar(value: str) -> str:
    """A value as PyYAML writes it by itself, end mark and all: in a plain or a quoted style, never a block."""
    import yaml

    return yaml.safe_dump(value, allow_unicode=True).strip() if value else json.dumps(value)


@pandas_udf(T.ArrayType(T.StringType()))
def yaml_scalars(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``yaml_scalar`` of arrays' values; nulls are left."""
    for batch in values:
        written = {v: yaml_scalar(v) for row in batch for v in row if v is not None}
        yield pd.Series([[written.get(v) for v in row] for row in batch])


@arrow_udf(T.ArrayType(T.StringType()))
def yaml_lists(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same without a Python object a row: distinct values of a batch are written once, all in one trip to Python."""
    for batch in values:
        coded = batch.flatten().dictionary_encode()
        written = pa.array([yaml_scalar(v) for v in coded.dictionary.to_pylist()], coded.dictionary.type)
        yield type(batch).from_arrays(pc.subtract(batch.offsets, batch.offsets[0]), written.take(coded.indices))


def lines_of(*parts: Column) -> Column:
    """Lines joined; a null part is left out, an empty one is an empty line."""
    return F.concat_ws("\n", *parts)


#: fixed values: header lines and what they show
HEADER = (("title", "name"), ("doc_id", "doc_no"), ("publish_date", "publish_date"), ("effective_date", "effective_date"), ("authority", "issuing_authority"), ("source", "source_pdf"))
EXTRA_HEADER = {
    "judgment": (("case_number", "case_number"), ("court", "court"), ("judgment_type", "judgment_type"), ("judgment_date", "judgment_date")),
    "book": (("author", "author"), ("publisher", "publisher"), ("isbn", "isbn"), ("book_date", "publish_date")),
}


def headers(meta: DataFrame, quote=yaml_lists) -> DataFrame:
    """doc_id, header: the block of metadata at the top, with a line end."""
    fields = [(label, F.nullif(F.col(c), F.lit(""))) for label, c in HEADER]
    plain = len(fields)
    for kind, extras in EXTRA_HEADER.items():
        fields += [(label, F.when(F.col("doc_type") == kind, F.try_element_at("extra", F.lit(k)))) for label, k in extras]
    rows = meta.withColumn("quoted", quote(F.array(*(v for _, v in fields))))
    shown = [F.concat(F.lit(f"{label}: "), F.col("quoted")[i]) for i, (label, _) in enumerate(fields)]
    shown.insert(plain, F.when(F.col("doc_type") != "unknown", F.concat(F.lit("doc_type: "), F.col("doc_type"))))
    return rows.select("doc_id", lines_of(F.lit("---"), *shown, F.lit("---"), F.lit("")).alias("header"))


def heading(level: Column, title: Column) -> Column:
    """A Markdown heading, or null for body levels."""
    n = heading_level(level)
    return F.when(n > 0, F.concat(F.repeat(F.lit("#"), n), F.lit(" "), title))


def block(nodes: DataFrame, anchors: bool = True) -> Column:
    """The lines of one node of ``all_nodes``."""
    then_blank = lambda c: (c, F.when(c.isNotNull(), ""))
    text = F.when(F.col("text") != "", F.when(F.col("level") == "footnote", F.concat(F.lit("<small>"), "text", F.lit("</small>"))).otherwise(F.col("text")))
    anchor = F.when(F.lit(anchors) & (F.col("level") == "article") & (F.col("number") != ""), F.concat(F.lit("<!-- anchor: article-"), "number", F.lit(" -->")))
    links = F.when(F.size("law_references") > 0, F.concat(F.lit("引用: "), F.array_join(F.transform("law_references", reference_link), ", ")))
    return lines_of(*then_blank(heading(F.col("level"), F.col("title"))), *then_blank(text), *then_blank(anchor), *then_blank(links))


def node_blocks(nodes: DataFrame, anchors: bool = True) -> DataFrame:
    return nodes.withColumn("block", block(nodes, anchors))


def bodies(nodes: DataFrame, *, toc: bool = False, anchors: bool = True) -> DataFrame:
    """doc_id, body: blocks in reading order, after a table of contents if asked for."""
    rows = node_blocks(nodes, anchors)
    entry = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("title"))
    # no filter on blocks before the grouping: it would make each block twice
    part = F.struct("node_pos", "leaf_no", "block", entry.alias("entry")) if toc else F.when(F.col("block") != "", F.struct("node_pos", "leaf_no", "block"))
    parts = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(part)).alias("parts")).where(F.size("parts") > 0)
    if not toc:
        return parts.select("doc_id", F.array_join("parts.block", "\n").alias("body"))
    body = F.array_join(F.filter(F.col("parts.block"), lambda b: b != ""), "\n")
    contents = lines_of(F.lit("## 目录\n"), F.array_join("parts.entry", "\n"), F.lit(""), F.lit("---"), F.lit(""))
    return parts.select("doc_id", lines_of(contents, body).alias("body"))


def markdown(nodes: DataFrame, meta: DataFrame, *, toc: bool = False, anchors: bool = True, quote=yaml_lists) -> DataFrame:
    """doc_id, content."""
    empty = lines_of(F.lit("## 目录\n"), F.lit(""), F.lit("---"), F.lit("")) if toc else F.lit(None).cast("string")
    return headers(meta, quote).join(bodies(nodes, toc=toc, anchors=anchors).hint("merge"), "doc_id", "left").select("doc_id", lines_of(F.col("header"), F.coalesce("body", empty)).alias("content"))


def node_json(level, title, text, number, page_num, path, references, children: Column) -> Column:
    """One node as JSON text, its children given as JSON texts."""
    own = F.to_json(F.struct(level.alias("level"), title.alias("title"), text.alias("text"), number.alias("number"), page_num.alias("page_num"), path.alias("hierarchy_path"), references.alias("law_references")))
    return F.concat(F.substr(own, F.lit(1), F.length(own) - 1), F.lit(',"children":['), F.array_join(children, ","), F.lit("]}"))


def trees_json(tree: DataFrame) -> DataFrame:
    """doc_id, tree: a JSON array of the roots, from ``tree.build``.

    Children are folded into their parents bottom-up in three passes, the
    depth of the level orders.
    """
    none = F.array().cast("array<string>")

    def leaf(x: Column) -> Column:
        return node_json(x["level"], x["title"], x["text"], F.lit(""), x["page_num"], leaf_path(x), law_references(full_text(x["title"], x["text"])), none)

    rows = tree.select("doc_id", "node_pos", "parent_pos", "parent_order", "sort_order", "level", "title", "text", "number", "page_num", "hierarchy_path", "law_references", F.transform("leaves", leaf).alias("below"))
    content = node_json(*(F.col(c) for c in ("level", "title", "text", "number", "page_num", "hierarchy_path", "law_references", "below")))
    for k in (3, 2, 1):
        child = F.coalesce(F.col("parent_order") == k, F.lit(False))
        kin = rows.withColumn("child", child).withColumn("json", F.when(child, content)).withColumn("place", F.when(child, F.col("parent_pos")).otherwise(F.col("node_pos")))
        own = F.max_by(F.struct(*rows.columns[1:]), ~F.col("child"))
        kids = F.array_sort(F.collect_list(F.when(F.col("child"), F.struct("node_pos", "json"))))
        kin = kin.groupBy("doc_id", "place").agg(own.alias("own"), kids.alias("kids"))
        rows = kin.select("doc_id", "own.*", "kids").withColumn("below", F.concat("below", F.col("kids.json"))).drop("kids")
    roots = rows.withColumn("json", content).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_pos", "json"))).alias("roots"))
    return roots.select("doc_id", F.concat(F.lit("["), F.array_join("roots.json", ","), F.lit("]")).alias("tree"))


def documents_json(tree: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_id, content: {"meta": …, "tree": …}; an extra value replaces a plain one of its name."""
    base = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("name", "name"), ("doc_id", "doc_no"), ("doc_type", "doc_type"), ("publish_date", "publish_date"), ("effective_date", "effective_date"), ("issuing_authority", "issuing_authority"), ("source_pdf", "source_pdf"))))
    replaced = F.transform(base, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at("extra", e["key"]), e["value"]).alias("value")))
    added = F.filter(F.map_entries("extra"), lambda e: ~F.array_contains(F.transform(base, lambda b: b["key"]), e["key"]))
    head = F.to_json(F.map_from_entries(F.concat(replaced, added)))
    return meta.join(trees_json(tree).hint("merge"), "doc_id", "left").select("doc_id", F.concat(F.lit('{"meta":'), head, F.lit(',"tree":'), F.coalesce("tree", F.lit("[]")), F.lit("}")).alias("content"))
