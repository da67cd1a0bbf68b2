"""The cleaning pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; between stages the table is written as Parquet and read again.  All but
the last return the columns of ``documents``, also where it has more than these.

Defined cases, for every stage: an empty table gives an empty one; a null text is
an empty one; very long texts are taken whole; columns beside doc_id and text may
have any names.  What a stage does with nulls, ties and repeated rows it says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import decontaminate, jaccard, packing, quality, substrings
from glossa.llm.common import once, stored, table, without

#: passages of more than this many words that repeat are cut
PASSAGE_WORDS = 50

#: SQL can't express the stages (a trained model, a linear program)
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts.

    Every row is judged by its text, so repeated rows go or stay together; a row
    without an id is judged and not learnt from; a score of just 0.5 is accepted;
    without positives all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, similarity 0.8) the document with the smallest id.

    Of rows that repeat id and text one stays, and of rows without an id that
    repeat a text; a row without an id is in no class, so its near copies, and
    copies of it that have an id, stay.
    """
    classes = jaccard.near_duplicates(docs, width=5, num=80, den=100)
    return without(once(docs, "doc_id", "text"), classes.where("component_id <> doc_id").select("doc_id"), "doc_id")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also stand in a document with a smaller id; n_chars follows the text.

    Rows without an id stay whole, and rows of one id cut nothing from one another.
    """
    cut = substrings.remove_repeats(docs, window=PASSAGE_WORDS + 1)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark item.

    Rows that share an id go together, and so do rows without one; null items leak nothing.
    """
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, leaks.select("doc_id"), "doc_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences; repeated rows and rows without an id are packed one by one."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
