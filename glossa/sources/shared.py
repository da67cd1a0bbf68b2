"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set one is made in local mode, and a cluster gets an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="glossa-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The table, written as Parquet to the shared folder and read again."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: rows that one task takes at once
TASK_ROWS = 50_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A stored table's rows, dealt by a key over as many tasks as they need, so that a task's share doesn't grow with the table.

    Rows are counted from the files' footers.
    """
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), key)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
