"""Command line: convert one file, a batch of files, or show the device's profile."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glossa")
    top.add_argument("-v", "--verbose", action="count", default=0)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("convert", "batch"):
        c = commands.add_parser(name)
        c.add_argument("path", help="PDF file or folder, or a Parquet table of lines")
        c.add_argument("-o", "--output", default="./output")
        c.add_argument("--max-pages", type=int)
        c.add_argument("--no-filter", action="store_true")
        c.add_argument("--format", choices=("md", "json"), default="md")
        c.add_argument("--ocr", choices=("off", "auto", "force"), default="off")
        c.add_argument("--backend", help="recognition backend: a registered name, or module:callable")
        c.add_argument("--rules", help="YAML file of cleaning rules")
        if name == "convert":
            c.add_argument("--toc", action="store_true")
            c.add_argument("--no-anchor", action="store_true")
            c.add_argument("--validate", action="store_true")
        else:
            c.add_argument("--flatten", action="store_true")
            c.add_argument("--workers", type=int, default=1, help="local parallelism; a cluster sets its own")
    commands.add_parser("profile")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, backend=None) -> int:
    """``backend`` makes an engine of ``sources.pdf.Backend`` for ``--ocr``; 0 is success, 1 some files failed, 2 a missing library."""
    from . import device
    from .plans.convert import Options, structure
    from .sources import backends, files, output, pdf, rules, shared

    args = parser().parse_args(argv)
    logging.basicConfig(level=(logging.WARNING, logging.INFO, logging.DEBUG)[min(args.verbose, 2)])
    spark = spark or SparkSession.builder.appName("glossa").getOrCreate()
    if args.command == "profile":
        print(device.profile(spark).summary(), file=sys.stderr)
        print(f"readers: {pdf.available()}", file=sys.stderr)
        return 0
    if args.backend:
        try:
            backend = backends.named(args.backend)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
    docs, unread, pages = None, [], None
    if args.path.rstrip("/").endswith(".parquet"):
        lines = spark.read.parquet(args.path)
    elif not pdf.available()["pdf"]:
        print("PDF files need pdfplumber, which is not installed; a Parquet table of lines works without", file=sys.stderr)
        return 2
    elif args.ocr != "off" and backend is None:
        print("recognition needs a backend: name one with --backend", file=sys.stderr)
        return 2
    else:
        found = files.pdf_files(spark, args.path, recursive=args.command == "batch")
        pages = shared.stored(pdf.read_pages(found, args.max_pages))  # several results read it
        lines = pdf.read_documents(pages, args.ocr, backend)
        docs = pdf.documents(found, pages)
        unread = pdf.failures(pages)
        for r in unread.toLocalIterator():
            print(f"{r.source_path}: {r.error}", file=sys.stderr)
        unread = unread.limit(1).collect()
    options = Options(max_pages=args.max_pages, filter_lines=not args.no_filter, toc=getattr(args, "toc", False), anchors=not getattr(args, "no_anchor", False), store=True)
    done = structure(lines, rules.load(args.rules), options, docs=docs)
    if getattr(args, "validate", False):
        for r in done.gaps().orderBy("doc_id", "node_pos").toLocalIterator():
            print(f"{r.doc_id}: {r.message}", file=sys.stderr)
    docs = done.json() if args.format == "json" else done.markdown()
    named = docs.withColumn("rel_path", files.output_path(F.col("doc_id").cast("string"), args.path, flatten=getattr(args, "flatten", False), extension=args.format))
    clashes = files.collisions(named).orderBy("rel_path")
    for r in clashes.toLocalIterator():
        print(f"{r.rel_path}: {r.n} documents would write this file; none does", file=sys.stderr)
    failed = output.write_files(files.without_collisions(named), args.output).where("not ok").count()
    clashed = not clashes.isEmpty()
    done.discard()
    if pages is not None:
        shared.discard(pages)
    return 1 if failed or unread or clashed else 0


if __name__ == "__main__":
    sys.exit(main())
