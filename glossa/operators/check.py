"""Articles: count and gaps in their numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import numeral_value


def articles(nodes: DataFrame) -> DataFrame:
    return nodes.where("level = 'article'")


def article_count(nodes: DataFrame) -> DataFrame:
    """doc_id, n_articles; unnumbered ones count too."""
    return articles(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_articles"))


def article_gaps(nodes: DataFrame) -> DataFrame:
    """doc_id, node_pos, prev_num, num, missing, message where a number jumps over the highest before it."""
    numbered = articles(nodes).where("number <> ''").withColumn("num", numeral_value(F.split("number", "之")[0]))
    before = Window.partitionBy("doc_id").orderBy("node_pos").rowsBetween(Window.unboundedPreceding, -1)
    jumps = numbered.withColumn("prev_num", F.max("num").over(before)).where("prev_num > 0 and num > prev_num + 1")
    missing = F.col("prev_num") + 1
    # fixed value: the wording of a gap's message
    message = F.concat(F.lit("条号不连续: 第"), F.col("prev_num"), F.lit("条 → 第"), F.col("num"), F.lit("条 (缺失第"), missing, F.lit("条)"))
    return jumps.select("doc_id", "node_pos", "prev_num", "num", missing.alias("missing"), message.alias("message"))
