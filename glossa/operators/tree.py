"""The hierarchy of nodes: parents, repeated headings, paths, leaves.

Levels have orders 1 to 4, so a node has at most three ancestors and no
recursion is needed.  All windows are over whole documents in reading order or
against it, on one exchange by document and three sorts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import full_text, heading_level, law_references, sort_order

ORDERS = (1, 2, 3, 4)


def parents(nodes: DataFrame) -> DataFrame:
    """sort_order, parent_pos (the last earlier node of a smaller order) and parent_order."""
    rows = nodes.withColumn("sort_order", sort_order(F.col("level")))
    before = Window.partitionBy("doc_id").orderBy("node_pos").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("sort_order") == k, F.struct(F.col("node_pos").alias("at"), F.col("sort_order").alias("of"))), ignorenulls=True).over(before) for k in ORDERS[:-1]}
    rows = rows.select("*", *(c.alias(f"last{k}") for k, c in last.items()))
    above = F.when(F.col("sort_order") == 2, F.col("last1")).when(F.col("sort_order") == 3, F.greatest("last1", "last2")).when(F.col("sort_order") == 4, F.greatest("last1", "last2", "last3"))
    return rows.withColumn("above", above).withColumn("parent_pos", F.col("above.at")).withColumn("parent_order", F.col("above.of")).drop("above", "last1", "last2", "last3")


def drop_repeated_headings(rows: DataFrame) -> DataFrame:
    """Without nodes that the next sibling repeats (same title and level) while they hold nothing, and all below them.

    ``rows`` as of ``parents``; hierarchy_path is added.  Of the nodes that follow
    and hang below a node of some order (0: below none), the nearest is a child or
    a sibling if there is any.
    """
    back = Window.partitionBy("doc_id").orderBy(F.desc("node_pos")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("doc_id").orderBy("node_pos").rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda on, value, window: F.last(F.when(on, value), ignorenulls=True).over(window)
    of = lambda k: F.coalesce("parent_order", F.lit(0)) == k
    own = lambda k: F.col("sort_order") == k
    said = F.struct("title", "level")
    rows = rows.withColumn("filled", (F.col("text") != "") | (F.size("leaves") > 0))
    # below order 3 there are no nodes, so what stays there is what is filled
    rows = rows.select("*", *(nearest(of(k), F.struct("parent_pos", said.alias("said")), back).alias(f"next{k}") for k in (0, *ORDERS[:-1])), nearest(of(3) & F.col("filled"), F.col("parent_pos"), back).alias("held"))
    sibling = reduce(lambda c, k: c.when(of(k), F.col(f"next{k}")), ORDERS[:-1], F.when(of(0), F.col("next0")))
    rows = rows.withColumn("sibling", sibling)
    repeated = F.col("sibling.parent_pos").eqNullSafe(F.col("parent_pos")) & (F.col("sibling.said") == said)
    rows = rows.withColumn("hollow", F.coalesce(repeated, F.lit(False)) & ~F.col("filled"))
    nodes = reduce(lambda c, k: c.when(own(k), F.col(f"next{k}.parent_pos") == F.col("node_pos")), ORDERS[1:-1], F.when(own(1), F.col("next1.parent_pos") == F.col("node_pos")))
    rows = rows.withColumn("has_nodes", F.coalesce(nodes, F.lit(False))).withColumn("gone", F.col("hollow") & own(4)).drop(*(f"next{k}" for k in (0, *ORDERS[:-1])), "sibling")
    # bottom up: a child that stays counts if it has text, leaves or nodes
    for k in (3, 2, 1):
        if k < 3:
            stays = of(k) & ~F.col("gone") & (F.col("filled") | F.col("has_nodes"))
            rows = rows.withColumn("held", nearest(stays, F.col("parent_pos"), back))
        holds = F.coalesce(F.col("held") == F.col("node_pos"), F.lit(False))
        rows = rows.withColumn("gone", F.when(own(k), F.col("hollow") & ~holds).otherwise(F.col("gone")))
    # top down: what hangs below a dropped node goes too
    rows = rows.select("*", *(nearest(own(k), F.struct("node_pos", "gone", "title"), before).alias(f"last{k}") for k in ORDERS[:-1]))
    gone, path = F.col("gone"), F.array().cast("array<string>")
    for k in ORDERS[:-1]:
        # the last node of an order is above this one unless one of a smaller order came between
        open_yet = reduce(lambda c, j: c & F.coalesce(F.col(f"last{j}.node_pos") < F.col(f"last{k}.node_pos"), F.lit(True)), range(1, k), F.col(f"last{k}").isNotNull())
        above = F.col("sort_order").isin(*ORDERS[k:]) & open_yet
        gone, path = gone | (above & F.coalesce(F.col(f"last{k}.gone"), F.lit(False))), F.concat(path, F.when(above, F.array(f"last{k}.title")).otherwise(F.array().cast("array<string>")))
    rows = rows.where(~gone).withColumn("hierarchy_path", F.concat(path, F.array("title")))
    return rows.drop("filled", "hollow", "gone", "has_nodes", "held", *(f"last{k}" for k in ORDERS[:-1]))


def build(nodes: DataFrame) -> DataFrame:
    """Structural nodes with parent, order, path, depth and their law references."""
    rows = drop_repeated_headings(parents(nodes))
    return rows.withColumn("depth", F.size("hierarchy_path") - 1).withColumn("law_references", law_references(full_text(F.col("title"), F.col("text"))))


# fixed values: the path entries of untitled leaves
LEAF_LABELS = {"clause": "款", "footnote": "脚注"}


def leaf_path(leaf: Column) -> Column:
    """Its label, below the title only where a font made the node a heading."""
    label = F.when(leaf["level"] == "clause", LEAF_LABELS["clause"]).when(leaf["level"] == "footnote", LEAF_LABELS["footnote"]).otherwise(leaf["text"])
    return F.concat(F.when(F.col("by_font"), F.array("title")).otherwise(F.array().cast("array<string>")), F.array(label))


def all_nodes(tree: DataFrame) -> DataFrame:
    """Structural nodes and leaves in one table; ascending (node_pos, leaf_no) is reading order.

    A node and its leaves come out of one row, so the tree is computed once.
    """

    def node(**columns: Column) -> Column:
        return F.struct(*(c.alias(k) for k, c in columns.items()))

    own = node(
        node_pos=F.col("node_pos"), leaf_no=F.lit(0), parent_pos=F.col("parent_pos"), level=F.col("level"), sort_order=F.col("sort_order"), heading_level=heading_level(F.col("level")), number=F.col("number"),
        title=F.col("title"), text=F.col("text"), hierarchy_path=F.col("hierarchy_path"), page_num=F.col("page_num"), law_references=F.col("law_references"), depth=F.col("depth"),
    )
    below = F.transform("leaves", lambda x: node(
        node_pos=x["pos"], leaf_no=F.lit(1), parent_pos=F.col("node_pos"), level=x["level"], sort_order=sort_order(x["level"]), heading_level=F.lit(0), number=F.lit(""),
        title=x["title"], text=x["text"], hierarchy_path=leaf_path(x), page_num=x["page_num"], law_references=law_references(full_text(x["title"], x["text"])), depth=F.col("depth") + 1,
    ))
    return tree.select("doc_id", F.inline(F.concat(F.array(own), below)))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes (of ``all_nodes``) that have nothing below them.

    What is below a node follows it in reading order, a child of its own first: a
    dropped child has taken along all below it.  Nodes without a document stay.
    """
    follows = F.lead("parent_pos").over(Window.partitionBy("doc_id").orderBy("node_pos", "leaf_no"))
    rows = nodes.withColumn("_above", (F.col("leaf_no") == 0) & F.col("doc_id").isNotNull() & F.coalesce(follows == F.col("node_pos"), F.lit(False)))
    return rows.where(~F.col("_above")).select(nodes.columns)
