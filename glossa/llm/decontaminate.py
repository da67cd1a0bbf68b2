"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Words are maximal runs without ASCII marks and white space, lower-cased.  A
seed is a fixed mask over ``SPAN`` consecutive words; it hashes the words where
the mask has a 1 and ignores the others, so a substituted word under a 0 does
not hide a hit.  Every window of every document is hashed under every mask and
joined with the hashes of the benchmark's windows; only the hash travels, not
the text.  A hit aligns an item with a document; in a second pass over the
documents that have hits the item's words are compared with the document's at
that alignment, place by place, and the item has leaked if at least ``share``
of its words agree.

The overlap around a hit is judged too.  A region is a maximal stretch of an alignment in which every
word lies in ``SPAN`` consecutive words of which ``AGREE`` agree; the shifts up
to ``DRIFT`` beside a hit's are looked at as well, for text after a dropped or
inserted word.  The item has also leaked if one region has ``run`` agreeing
words (all words of a shorter item), or if the item's places that agree in
regions of any shift, taken together, reach ``share``; ``matched`` is then the
larger of that union and the best alignment, whose shift ``place`` tells.

Items of fewer than ``SHORT`` words, in which few windows find room, have the
masks ``SHORT_MASKS`` of four words besides, or all their words as one seed if they
are fewer.  At the edge of the rule (as many substitutions, at random places, as
``share`` allows) the seeds find 0.97 or more of the items of any length from ``SPAN`` words.
An item of fewer than ``SPAN`` words has leaked only if all its words stand together.

The benchmark's seeds and words, and the alignments with their items' words, are
sent to all tasks only up to ``MAX_SENT``; beyond that both sides are shuffled.  A
document's words meet its items one by one, and only which words agree goes on.

Defined cases: rows that share a doc_id are one document, rows without one too;
null and empty texts and items have no words and no part; repeated items and
rows are each reported once a pair; of alignments that tie the first is told; very
long texts are taken whole; an empty table, of either, gives no rows; a null doc_id
or item_id is kept as null; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SPAN = 8
MASKS = ("11101011", "11011101", "10110111")
MAX_SENT = 500_000

#: masks that items of fewer words have besides
SHORT, SHORT_MASKS = 25, ("1111", "110011", "1101001")

#: agreeing words of a region that are a leak by themselves; those of any SPAN words in a region; shifts looked at beside a hit
RUN, AGREE, DRIFT = 13, 6, 3


def words_of(text: Column) -> Column:
    apart = F.split(F.lower(text.cast("string")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.filter(apart, lambda w: w != "")


def windows(rows: DataFrame, keep: list[str], masks: dict[str, Column]) -> DataFrame:
    """The columns to keep, a window's place (from 0) and its seed, for the masks whose condition the row meets.

    One explode serves masks of all widths: past the last word there are nulls, and a
    mask with its last place there has no seed.  Only places are exploded, and words
    read from the one array: windows as structs made some 300 bytes of garbage a word.
    """
    size = F.size("h")
    placed = rows.select(*keep, size.alias("size"), "h", F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("place"))
    word = lambda i: F.get("h", F.col("place") + i)
    seed = lambda m: F.xxhash64(F.lit(m), *(word(i) for i, c in enumerate(m) if c == "1"))
    seeds = [F.when(met & word(len(m) - 1).isNotNull(), seed(m)) for m, met in masks.items()]
    return placed.select(*keep, "place", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def agreeing(item_words: Column, words: Column, shift: Column) -> Column:
    """Whether each of the item's words agrees with the document's at its place."""
    return F.transform(item_words, lambda w, p: F.coalesce(F.get(words, p + shift) == w, F.lit(False)))


def leaked_regions(each: DataFrame, share: float, run: int) -> DataFrame:
    """doc, item, b of the items leaked by an alignment, a region or the union of regions."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("item_words") - SPAN, F.lit(0)))
    good = F.transform(starts, lambda p: F.size(F.filter(F.slice("agree", p + 1, SPAN), lambda x: x)) >= AGREE)
    # windows that hold place p start at p - SPAN + 1 to p
    inside = lambda p: F.exists(F.slice("good", F.greatest(p - (SPAN - 1), F.lit(0)) + 1, F.least(p, F.lit(SPAN - 1)) + 1), lambda g: g)
    marks = F.transform("agree", lambda a, p: F.when(~inside(p), "0").when(a, "1").otherwise("x"))
    marked = each.withColumn("good", good).withColumn("marks", marks)
    longest = F.array_max(F.transform(F.split(F.array_join("marks", ""), "0+"), lambda r: F.length(F.replace(r, F.lit("x"), F.lit("")))))
    places = F.filter(F.transform("marks", lambda m, p: F.when(m == "1", p)), lambda p: p.isNotNull())
    judged = marked.select("doc", "item", "words", "shift", "item_words", "matched", longest.alias("longest"), places.alias("places"))
    top = F.max(F.struct("matched", (-F.col("shift")).alias("back"), "item_words")).alias("b")
    # items that share an id are judged text by text
    whole = judged.groupBy("doc", "item", "words").agg(top, F.max("longest").alias("longest"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("union"))
    matched = F.greatest("b.matched", "union")
    long = F.col("b.item_words") >= SPAN
    leaked = whole.where((F.col("b.matched") == F.col("b.item_words")) | long & ((matched >= F.lit(share) * F.col("b.item_words")) | (F.col("longest") >= F.least(F.lit(run), F.col("b.item_words")))))
    return leaked.groupBy("doc", "item").agg(F.max(F.struct(matched.alias("matched"), F.col("b.back").alias("back"), F.col("b.item_words").alias("item_words"))).alias("b"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = 0.7, run: int = RUN) -> DataFrame:
    """A row per document and leaked item: doc_id, item_id, place (of the item in the document's words), item_words, matched, overlap."""
    hashed = lambda c: F.transform(words_of(F.col(f"`{c}`")), lambda w: F.xxhash64(w))
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), hashed(item_text_col).alias("h"))
    size = F.size("h")
    tiny = F.when(size.between(1, len(SHORT_MASKS[0]) - 1), size)
    total, short, widths = items.agg(F.sum(size + 1), F.coalesce(F.max(size.between(len(SHORT_MASKS[0]), SHORT - 1)), F.lit(False)), F.array_sort(F.collect_set(tiny))).first()
    masks = {m: F.lit(True) for m in MASKS} | {m: F.col("size") < SHORT for m in SHORT_MASKS if short} | {"1" * w: F.col("size") == w for w in widths}
    seeds = windows(items, ["item"], masks).select("item", F.col("place").alias("item_place"), "seed").distinct()
    # a word and its windows
    if (total or 0) * (1 + len(masks)) <= MAX_SENT:
        seeds, items = F.broadcast(seeds), F.broadcast(items)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    of_docs = windows(rows.select("doc", hashed("text").alias("h")), ["doc"], dict.fromkeys(masks, F.lit(True)))
    hits = of_docs.join(seeds, "seed").select("doc", "item", (F.col("place") - F.col("item_place")).alias("shift"))
    aligned = checkpointed(hits.groupBy("doc", "item").agg(F.collect_set("shift").alias("shifts")))
    found = aligned.join(items.select(F.col("item").alias("of"), F.col("h").alias("item_h")), F.col("item").eqNullSafe(F.col("of"))).select(F.col("doc").alias("hit_doc"), "item", "shifts", "item_h")
    sent = (found.agg(F.sum(F.size("shifts") + F.size("item_h"))).first()[0] or 0) <= MAX_SENT
    here = aligned.select(F.col("doc").alias("hit_doc"))
    near = F.col("doc").eqNullSafe(F.col("hit_doc"))
    suspects = rows.join(F.broadcast(here) if sent else here, near, "left_semi").select("doc", hashed("text").alias("h"))
    beside = F.array_distinct(F.flatten(F.transform("shifts", lambda s: F.sequence(s - DRIFT, s + DRIFT))))
    placed = F.transform(beside, lambda s: F.struct(s.alias("shift"), agreeing(F.col("item_h"), F.col("h"), s).alias("agree")))
    # each shift's agreement is taken where the words are; the words themselves go no further
    judged = suspects.join(F.broadcast(found) if sent else found, near).select("doc", "item", F.xxhash64("item_h").alias("words"), F.size("item_h").alias("item_words"), F.explode(placed).alias("at"))
    each = judged.select("doc", "item", "words", "item_words", "at.shift", "at.agree").withColumn("matched", F.size(F.filter("agree", lambda x: x)))
    best = leaked_regions(each, share, run)
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col if item_col != id_col else "item"), (-F.col("b.back")).cast("int").alias("place"), F.col("b.item_words").alias("item_words"), F.col("b.matched").alias("matched"), (F.col("b.matched") / F.col("b.item_words")).alias("overlap"))
