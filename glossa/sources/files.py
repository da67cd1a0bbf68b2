"""Finding input files and naming outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pdf_files(spark: SparkSession, path: str, *, recursive: bool = True, content: bool = True) -> DataFrame:
    """path, length and content of the PDF files of a folder, or of one file."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf")
    rows = reader.load(path)
    return rows.select("path", "length", "content") if content else rows.select("path", "length")


def output_path(path: Column, root: str, *, flatten: bool = False, extension: str = "md") -> Column:
    """The output's path below its folder: sub-folders kept, or the base name alone."""
    root = root.rstrip("/") + "/"
    below = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(F.regexp_extract(path, "([^/]*)$", 1))
    named = F.regexp_extract(below, "([^/]*)$", 1) if flatten else below
    return F.concat(F.regexp_replace(named, r"\.[^./]*$", ""), F.lit(f".{extension}"))


def collisions(outputs: DataFrame) -> DataFrame:
    """Output paths that more than one document would write."""
    return outputs.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def without_collisions(outputs: DataFrame) -> DataFrame:
    """The documents whose output path is their own."""
    return outputs.join(collisions(outputs).select("rel_path"), "rel_path", "left_anti")
