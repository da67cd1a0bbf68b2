"""The whole run: lines to structured documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import check, clean, metadata, ocr, render, segment, tree
from ..sources import shared
from ..sources.rules import Rules


@dataclass
class Options:
    max_pages: int | None = None
    filter_lines: bool = True
    toc: bool = False
    anchors: bool = True
    #: store metadata and annotated lines in the checkpoint folder, each of which more than one step reads
    store: bool = False
    #: of the results only one is wanted, so annotated lines are read once and never stored
    single: bool = False


@dataclass
class Structured:
    """Lazy results; nothing is computed until one of them is used."""

    meta: DataFrame
    #: metadata without the lines before the first node, which no header shows
    heads: DataFrame
    annotated: DataFrame
    tree: DataFrame
    nodes: DataFrame
    options: Options
    #: intermediate tables of ``Options.store``
    stored: tuple[DataFrame, ...] = ()

    def discard(self) -> None:
        """Delete the stored intermediate tables, once all results that are wanted have been written."""
        shared.discard(*self.stored)

    def markdown(self) -> DataFrame:
        return render.markdown(self.nodes, self.heads, toc=self.options.toc, anchors=self.options.anchors)

    def json(self) -> DataFrame:
        return render.documents_json(self.tree, self.meta)

    def gaps(self) -> DataFrame:
        return check.article_gaps(self.nodes)

    def counts(self) -> DataFrame:
        return check.article_count(self.nodes)


def structure(lines: DataFrame, rules: Rules | None = None, options: Options | None = None, source: str | None = None, docs: DataFrame | None = None) -> Structured:
    """lines: LINES as extracted.  Metadata sees the first page before anything is dropped or sorted.

    Every document of ``docs`` (doc_id), and without it every one with a line on
    any page, is in the results.
    """
    rules, options = rules or Rules(), options or Options()
    if docs is None and options.max_pages is not None:
        docs = lines.select("doc_id")
    lines = ocr.first_pages(lines, options.max_pages)
    heads = meta = metadata.metadata(clean.normalize_lines(lines, rules), source, docs)
    tables, books = [], True
    if options.store:
        heads = shared.stored(meta)
        tables.append(heads)
        meta, books = shared.dealt(heads, "doc_id"), not heads.where("doc_type = 'book'").isEmpty()

    def cleaned(rows: DataFrame) -> DataFrame:
        rows = clean.normalize_lines(rows, rules)
        return clean.filter_lines(rows, rules) if options.filter_lines else rows

    annotated = segment.annotate(lines, meta.select("doc_id", "doc_type"), cleaned, books)
    if options.store and not options.single:
        tables.append(shared.stored(annotated))
        annotated = shared.dealt(tables[-1], "doc_id")
    built = tree.build(segment.nodes_of(annotated))
    return Structured(metadata.with_preamble(meta, segment.preambles(annotated)), heads, annotated, built, tree.all_nodes(built), options, tuple(tables))
