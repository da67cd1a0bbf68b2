"""Documents as they arrive.

A file arrives whole and every operator works within a document, so a stream
of lines needs no state of its own: each micro-batch is structured like a
table.  Lines of a document must arrive in one batch (one file a document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.convert import Options, structure
from ..schema import LINES
from ..sources.rules import Rules


def line_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of Parquet files of LINES rows."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def structure_stream(lines: DataFrame, output: str, checkpoint: str, *, rules: Rules | None = None, options: Options | None = None, form: str = "markdown", once: bool = True) -> StreamingQuery:
    """Writes doc_id, content of each batch below ``output``; a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        done = structure(batch, rules, options)
        (done.json() if form == "json" else done.markdown()).write.mode("overwrite").parquet(f"{output}/batch={number}")

    started = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()
