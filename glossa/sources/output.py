"""Writing documents: a table by default, or one file a document."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row


def write_table(docs: DataFrame, path: str, mode: str = "error") -> None:
    docs.write.mode(mode).parquet(path)


def write_files(docs: DataFrame, folder: str) -> DataFrame:
    """Each row's content to ``folder``/rel_path, in a folder that all executors share; gives rel_path, ok, error.

    A document that can't be written does not stop the others.  JSON is
    indented.
    """

    def write(rows: Iterator[Row]) -> Iterator[tuple]:
        for r in rows:
            try:
                target = os.path.join(folder, r.rel_path)
                os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                text = json.dumps(json.loads(r.content), ensure_ascii=False, indent=2) if r.rel_path.endswith(".json") else r.content
                with open(target + ".part", "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(target + ".part", target)  # a task that runs twice leaves one whole file
                yield r.rel_path, True, ""
            except Exception as e:
                yield r.rel_path, False, str(e)

    def batches(parts):
        import pandas as pd

        for part in parts:
            yield pd.DataFrame(list(write(part.itertuples(index=False))), columns=["rel_path", "ok", "error"])

    return docs.select("rel_path", "content").mapInPandas(batches, "rel_path string, ok boolean, error string")
