"""PDF and OCR readers.

Decoding needs libraries that the engine does not require: ``pdfplumber`` for
text, ``fitz`` with an OCR backend for images.  They are imported on the
executors when a file is read; without them ``available`` says so and reading
reports an error a file, not a failed job.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from functools import partial
from io import BytesIO
from typing import Any, Protocol
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import device
from ..operators import ocr
from ..operators.words import HEIGHT, TOLERANCE
from ..schema import LINES
from . import shared

CHARS = "array<struct<size:double,fontname:string>>"
#: what a reader yields a page: its lines, its tables, its size, or the error that stopped the file
PAGES = f"source_path string, page_num int, n_chars long, width_pt double, height_pt double, lines array<struct<text:string,x0:double,y0:double,x1:double,y1:double,chars:{CHARS}>>, tables array<array<array<string>>>, error string"


class Backend(Protocol):
    """Recognises the boxes of a page image: (dt_polys, rec_texts, rec_scores)."""

    name: str

    def page(self, image: Any) -> tuple[list, list, list]: ...

    def release(self) -> None: ...


def available() -> dict[str, bool]:
    """Which readers this Python can use."""
    have = lambda m: importlib.util.find_spec(m) is not None
    return {"pdf": have("pdfplumber"), "images": have("fitz"), "ocr": have("paddleocr")}


def lines_of_words(found: list[dict]) -> list[dict]:
    """A page's words on lines, for pages whose lines can't be had; as ``operators.words.cluster_words``, without fonts."""
    lines: list[dict] = []
    for w in found:
        if not w["text"].strip():
            continue
        if not lines or abs(w["top"] - lines[-1]["y0"]) > TOLERANCE:
            lines.append({"text": "", "x0": float(w["x0"]), "y0": float(w["top"]), "x1": float(w["x1"]), "y1": float(w["top"]) + HEIGHT, "chars": []})
        now = lines[-1]
        now["text"] += w["text"].strip()
        now["x0"], now["x1"] = min(now["x0"], float(w["x0"])), max(now["x1"], float(w["x1"]))
    return lines


def read_pages(files: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages of PDF files (path, content), a page at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_path", "page_num", "n_chars", "width_pt", "height_pt", "lines", "tables", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    import pdfplumber

                    with pdfplumber.open(BytesIO(content)) as pdf:
                        pages = pdf.pages[: max_pages or None] if not max_pages or max_pages > 0 else []
                        for k, page in enumerate(pages, 1):
                            lines, tables = [], []
                            if len(page.chars) <= ocr.PAGE_LIMIT:
                                for x in page.extract_text_lines(strip=True):
                                    chars = [{"size": float(c.get("size") or 0), "fontname": c.get("fontname") or ""} for c in x.get("chars") or []]
                                    lines.append({"text": x["text"], "x0": float(x["x0"]), "y0": float(x["top"]), "x1": float(x["x1"]), "y1": float(x["bottom"]), "chars": chars})
                                if not lines:
                                    lines = lines_of_words(page.extract_words(keep_blank_chars=False, x_tolerance=3))
                                tables = [[[c or "" for c in row] for row in t] for t in page.extract_tables()]
                            yield pd.DataFrame([(path, k, len(page.chars), float(page.width), float(page.height), lines, tables, None)], columns=names)
                            page.close()
                except Exception as e:
                    yield pd.DataFrame([(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")], columns=names)

    return files.select("path", "content").mapInPandas(read, PAGES)


def page_lines(pages: DataFrame) -> DataFrame:
    """LINES of the pages' text and tables; the path is the document."""
    from ..functions.text import strip
    from ..operators.words import font_name, font_size, is_bold, table_lines

    own = ocr.within_limit(pages.where("error is null"))
    tables = own.select(F.col("source_path").alias("doc_id"), "page_num", F.posexplode("tables").alias("table_no", "cells"))
    tables = table_lines(tables).withColumn("source_path", F.col("doc_id")).select([f.name for f in LINES])
    rows = own.select("source_path", "page_num", F.posexplode("lines").alias("line_no", "x")).where(strip(F.col("x.text")) != "")
    return tables.unionByName(rows.select(F.col("source_path").alias("doc_id"), "source_path", "line_no", strip(F.col("x.text")).alias("text"), "page_num", *(F.col(f"x.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")), font_size(F.col("x.chars")).alias("font_size"), is_bold(F.col("x.chars")).alias("bold"), font_name(F.col("x.chars")).alias("fontname"), F.lit(False).alias("is_table")).select([f.name for f in LINES]))


def failures(pages: DataFrame) -> DataFrame:
    """source_path, error of the files that could not be read."""
    return pages.where("error is not null").select("source_path", "error")


def whole(pages: DataFrame) -> DataFrame:
    """Pages of the files that were read to their end: a file is taken whole or not at all."""
    return pages.where("error is null").join(failures(pages).select("source_path").distinct(), "source_path", "left_anti")


def documents(files: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id of every file that could be read, also of those without pages."""
    return files.select(F.col("path").alias("doc_id")).join(failures(pages).select(F.col("source_path").alias("doc_id")).distinct(), "doc_id", "left_anti")


def read_documents(pages: DataFrame, mode: str = "off", backend: Callable[[], Backend] | None = None, recogniser: Callable | None = None, gpus: float = 0) -> DataFrame:
    """LINES of pages, from their text or, where ``ocr.needs_ocr`` says so, from their images.

    A page that is recognised has no other lines; one whose recognition fails has
    those of its text, but no tables.  ``recogniser`` stands for ``recognise``; its
    result is stored, since the lines and the failed pages are both read from it.
    ``gpus``: graphics units of a recognising task, see ``recognise``.
    """
    if mode == "off":
        return page_lines(whole(pages))
    routed = ocr.within_limit(whole(pages)).withColumn("routed", ocr.needs_ocr(F.col("n_chars"), mode))
    wanted = routed.where("routed").select("source_path", "page_num", ocr.resolution(F.col("width_pt"), F.col("height_pt")).alias("dpi"))
    boxes = shared.stored((recogniser or partial(recognise, gpus=gpus))(wanted, backend))
    failed = boxes.where("error is not null").select(F.col("doc_id").alias("source_path"), "page_num")
    back = routed.where("routed").join(failed, ["source_path", "page_num"], "left_semi").withColumn("tables", F.array().cast("array<array<array<string>>>"))
    text = routed.where("not routed").unionByName(back)
    return page_lines(text).unionByName(ocr.lines_of_boxes(boxes.where("error is null")))


def open_path(path: str) -> bytes:
    """A file's bytes, in a task: of a path or URI that the driver and all executors can reach."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + unquote(path[len("file:") :]).lstrip("/")
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return f.read()


def page_images(content: bytes, pages: list[tuple[int, int]]) -> Iterator[Any]:
    """The image of each (page_num, dpi), or the exception that it raised; the file is opened once."""
    import fitz
    from PIL import Image

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page_num, dpi in pages:
            try:
                scale = dpi / 72.0
                shot = doc.load_page(page_num - 1).get_pixmap(matrix=fitz.Matrix(scale, scale), colorspace=fitz.csRGB)
                yield Image.frombytes("RGB", (shot.width, shot.height), shot.samples)
            except Exception as e:
                yield e


#: what recognition yields a page: boxes, or the error that sends the page back to its text
BOXES = "doc_id string, page_num int, dt_polys array<array<array<double>>>, rec_texts array<string>, rec_scores array<double>, dpi int, error string"


def recognise(wanted: DataFrame, backend: Callable[[], Backend], *, images: Callable = page_images, opener: Callable[[str], bytes] = open_path, gpus: float = 0) -> DataFrame:
    """BOXES of pages (wanted: source_path, page_num, dpi).

    Only paths and page numbers travel.  A task opens a file once for a batch of up
    to ``ocr.BATCH`` of its pages and releases the engine after the batch, which
    bounds what an engine holds on to.  A page that fails yields an error and leaves
    the others of its batch alone; a file or engine that fails yields one a page.
    ``gpus`` are asked for in this stage alone, on a cluster; a backend learns its
    unit, or that it has none, from ``device.task_device``.
    """

    def batch_boxes(path: str, pages: list[tuple[int, int]]) -> Iterator[tuple]:
        failed, engine, done = None, None, 0
        try:
            engine = backend()
            for (page_num, dpi), image in zip(pages, images(opener(path), pages), strict=True):
                try:
                    if isinstance(image, Exception):
                        raise image
                    polys, texts, scores = engine.page(image)
                    row = (path, page_num, [[[float(v) for v in point] for point in box] for box in polys], list(texts), [float(v) for v in scores], dpi, None)
                except Exception as e:
                    row = (path, page_num, None, None, None, dpi, f"{type(e).__name__}: {e}")
                yield row
                done += 1
        except Exception as e:
            failed = f"{type(e).__name__}: {e}"
        finally:
            if engine is not None:
                engine.release()
        if failed:
            yield from ((path, page_num, None, None, None, dpi, failed) for page_num, dpi in pages[done:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in BOXES.split(", ")]
        for batch in batches:
            for r in batch.itertuples(index=False):
                for row in batch_boxes(r.source_path, [(int(p["page_num"]), int(p["dpi"])) for p in r.pages]):
                    yield pd.DataFrame([row], columns=names)

    conf = wanted.sparkSession.sparkContext.getConf()
    profile = device.gpu_profile(conf.get("spark.master", "local"), conf.get("spark.dynamicAllocation.enabled", "false") == "true", gpus, conf.get("spark.executor.resource.gpu.discoveryScript", ""))
    number = F.expr(f"(page_num - 1) div {ocr.BATCH}").alias("batch")
    rows = wanted.groupBy("source_path", number).agg(F.array_sort(F.collect_list(F.struct("page_num", "dpi"))).alias("pages"))  # BATCH pages at most
    return rows.select("source_path", "pages").mapInPandas(run, BOXES, profile=profile)
