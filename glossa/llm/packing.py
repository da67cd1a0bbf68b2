"""Sequence packing by cutting-stock column generation.

Documents are tokenised once; a document longer than a sequence is cut into
full sequences and a rest, so every piece is at most a sequence long.  Piece
lengths fall into size classes of ``step`` tokens, and their histogram is the
demand of a cutting-stock problem: a linear program over patterns (how many
pieces of each class share a sequence), whose columns are priced by a knapsack
dynamic program.  The optimal patterns are rounded down, what is left is packed
first-fit decreasing, and pieces, ranked within their class, take the places of
the patterns.

The driver holds the histogram (a number a class) and the patterns, never
documents; ranks come from per-shard counts, so that a length that a third of
all pieces share is no single task's work.

Defined cases: a null or empty text has only the end id; a very long one fills
sequences of its own and leaves a rest; repeated rows are packed one by one;
pieces of equal length are ranked by id, start and content; a null doc_id is
kept, an id that is no whole number is an error; an empty table gives none; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, texts_of, worker_slot

CAPACITY, STEP, END_ID = 4096, 8, 2

#: most shards for ranks: with the classes, a bound on the rows of the offset table
SHARDS = 512

#: letters, then marks that always start a token of their own
SIMPLE = re.compile(r"([^\W\d_]+)([.,!?;:|*#$%&]+)")


def splits(word: str) -> re.Match | None:
    """Letters and marks of a word whose marks stand alone: the tokenizer joins them with a combining mark in which the letters' normal form ends."""
    found = SIMPLE.fullmatch(word)
    if not found or found[1].isascii() or unicodedata.category(unicodedata.normalize("NFC", found[1].lower())[-1])[0] == "L":
        return found
    return None


#: bytes of small letters of ASCII and Latin-1 (U+00DF to U+00FF but the division sign) in UTF-8: no normal form joins or changes them
LETTERS = bytes([*range(ord("a"), ord("z") + 1), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)])
#: the marks of SIMPLE
MARKS = b".,!?;:|*#$%&"

#: bytes of LETTERS for which a byte-level vocabulary has other characters than Latin-1
OTHERS = {"\x9f": "\u0141", "\xa0": "\u0142", "\xad": "\u0143"}

#: words by which a tokenizer is tried: are letters tokenised by its model alone?
PROBE = ["the", "q", "ünder", "straße", "àéîõ", "niñez", "andonanednt"]

#: parts words that are tokenised together: a character with a token of its own
PARTING = "\x01"


class TokenCache:
    """Token ids of texts, as little-endian 32-bit integers, made of those of their words.

    The tokenizer splits at white space and never joins across it, so a text's
    ids are those of its words; a word's trailing marks are split off too.  It
    ignores A-Z case but in added tokens, all of which hold ``<|``; texts with that
    mark keep their case.  New words of some texts are tokenised in one call, and those
    of LETTERS, which the tokenizer neither changes nor splits, by its model alone, whose
    suffix at a word's last token tells words apart.
    Two generations of at most ``limit`` words and ``size`` bytes of words are kept.
    """

    limit, size, piece = 100_000, 1 << 22, 1 << 19

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.parting = self.tokenizer.encode(PARTING, add_special_tokens=False).ids
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        self.model = Tokenizer(self.tokenizer.model)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.last[[i for t, i in self.model.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        probe = [w.encode() for w in PROBE]
        self.alone = self.by_model(probe) == [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in PROBE]

    def by_model(self, words: list[bytes]) -> list[bytes] | None:
        """Ids of words of LETTERS, or None where the words can't be told apart."""
        chars = b" ".join(words).decode("latin-1")
        for byte, char in OTHERS.items():
            chars = chars.replace(byte, char)
        found = np.array(self.model.encode_batch_fast([chars.split(" ")], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.last[found]) + 1)).tolist()
        if len(ends) != len(words):
            return None
        data = found.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def tokenise(self, words: list[bytes]) -> None:
        able = len(self.parting) == 1
        odd = [w for w in words if not able or b"<|" in w or PARTING.encode() in w]
        plain = sorted(set(words).difference(odd))
        if plain:
            joined = self.tokenizer.encode_batch_fast([f" {PARTING} ".join(w.decode() for w in plain)], add_special_tokens=False)
            found = np.array(joined[0].ids, dtype="<u4")
            cuts = np.r_[-1, np.flatnonzero(found == self.parting[0]), len(found)].tolist()
            data = found.tobytes()
            for w, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True):
                self.ids[w] = data[4 * (a + 1) : 4 * b]
        for w in odd:
            self.ids[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Put words that are not known into the cache."""
        kept = words & self.old.keys()
        self.ids.update((w, self.old[w]) for w in kept)
        fresh = words.difference(kept) if kept else words
        plain: dict[bytes, bytes] = {}
        cores: set[bytes] = set()
        if self.alone:
            plain = {w: core for w in fresh if (core := w.rstrip(MARKS)) and not core.translate(None, LETTERS)}
            fresh = fresh.difference(plain)
            cores = set(plain.values()).difference(self.ids)
            again = cores & self.old.keys()
            self.ids.update((w, self.old[w]) for w in again)
            new = list(cores - again)
            found = self.by_model(new) if new else []
            self.ids.update(zip(new, found or [], strict=found is not None))
            cores = set(new) if found is None else set()
            plain = {w: core for w, core in plain.items() if len(core) < len(w)}
        matched = [(w, splits(w.decode())) for w in fresh]
        parts = {w: (m[1].encode(), m[2].encode()) for w, m in matched if m}
        needed = {w for w, m in matched if not m}.union(cores, (w[len(core) :] for w, core in plain.items()), *parts.values())
        self.tokenise([w for w in needed if w not in self.ids])
        for w, core in plain.items():
            self.ids[w] = self.ids[core] + self.ids[w[len(core) :]]
        for w, (core, marks) in parts.items():
            self.ids[w] = self.ids[core] + self.ids[marks]
        self.held += sum(map(len, words))

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            words, size = [], 0
            while at < len(texts) and size < self.piece:
                text = texts[at] or b""
                words.append((text if b"<|" in text else text.lower()).split())
                size += len(text)
                at += 1
            distinct = set().union(*words)
            if len(self.ids) > self.limit or self.held > self.size:
                self.old, self.ids, self.held = self.ids, {}, 0
            if new := distinct.difference(self.ids):
                self.learn(new)
            for own in words:
                yield b"".join(map(self.ids.__getitem__, own))


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    end = np.array([END_ID], dtype="<u4").tobytes()
    width = 4 * CAPACITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_slot(f"tokens {tokenizer}", lambda: TokenCache(tokenizer))
        for batch in batches:
            out: list[tuple] = []
            for i, ids in zip(batch.column("id").to_pylist(), cache.encode(texts_of(batch)), strict=True):
                ids += end
                total = len(ids) // 4
                out += [(i, at // 4, len(part) // 4, zlib.crc32(part), total) for at in range(0, len(ids), width) for part in (ids[at : at + width],)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """Counts of the items of the most valuable multiset that fits."""
    best, chosen = np.zeros(room + 1), np.full(room + 1, -1)
    for space in range(1, room + 1):
        fits = int(np.searchsorted(sizes, space, side="right"))
        best[space], chosen[space] = best[space - 1], -1
        if fits:
            got = values[:fits] + best[space - sizes[:fits]]
            i = int(got.argmax())
            if got[i] > best[space] + 1e-12:
                best[space], chosen[space] = got[i], i
    counts, space = np.zeros(len(sizes), dtype=np.int64), room
    while space > 0:
        if chosen[space] < 0:
            space -= 1
        else:
            counts[chosen[space]] += 1
            space -= int(sizes[chosen[space]])
    return counts


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (a column each) and how often each is used, by the revised simplex method.

    The basis starts with a pattern for each class alone.  ``rounds`` bounds the
    columns generated; any basis on the way is a feasible packing.
    """
    m = len(sizes)
    alone = room // sizes
    basis = np.diag(alone).astype(np.float64)
    inverse = np.diag(1.0 / alone)
    used = demand / alone
    for _ in range(rounds):
        duals = inverse.sum(0)
        column = knapsack(np.maximum(duals, 0), sizes, room).astype(np.float64)
        if duals @ column <= 1 + 1e-7:
            break
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, used / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        length = ratio[out]
        used = np.maximum(used - length * step, 0)
        used[out] = length
        basis[:, out] = column
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    return np.rint(basis).astype(np.int64), used


def plan(histogram: dict[int, int], room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class sizes, patterns (a row each: pieces of each class) and how many sequences use each."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[s] for s in sizes], dtype=np.float64)
    columns, used = solve_patterns(sizes, demand, room)
    times = np.floor(used + 1e-9).astype(np.int64)
    patterns: dict[tuple, int] = {}
    left = demand.astype(np.int64).copy()
    for p in np.argsort(-times, kind="stable"):
        row = columns[:, p]
        n = int(min([times[p], *(left[row > 0] // row[row > 0])])) if row.any() else 0
        if n > 0:
            patterns[tuple(row.tolist())] = patterns.get(tuple(row.tolist()), 0) + n
            left -= n * row
    # first-fit decreasing by whole rows: what is left is a few pieces a class
    while left.any():
        row, space = np.zeros(len(sizes), dtype=np.int64), room
        for c in range(len(sizes) - 1, -1, -1):
            if left[c] and sizes[c] <= space:
                row[c] = min(left[c], space // sizes[c])
                space -= int(row[c] * sizes[c])
        n = int((left[row > 0] // row[row > 0]).min())
        patterns[tuple(row.tolist())] = patterns.get(tuple(row.tolist()), 0) + n
        left -= n * row
    return sizes, np.array(list(patterns), dtype=np.int64).reshape(len(patterns), len(sizes)), np.array(list(patterns.values()), dtype=np.int64)


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    spark = docs.sparkSession
    room = CAPACITY // STEP
    shards = max(1, min(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pieces = checkpointed(pieces_of(docs, tokenizer, id_col, text_col))
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / STEP).cast("int")).withColumn("shard", F.pmod(F.xxhash64("id", "start"), F.lit(shards)).cast("int"))
    counts = pieces.groupBy("size", "shard").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if not histogram:
        return spark.createDataFrame([], schema)
    sizes, patterns, times = plan(histogram, room)
    first = np.cumsum(times) - times
    places: dict[int, tuple] = {}
    for c, size in enumerate(sizes.tolist()):
        with_it = np.flatnonzero(patterns[:, c])
        share = patterns[with_it, c]
        places[size] = (np.cumsum(share * times[with_it]) - share * times[with_it], share, first[with_it])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = np.asarray(batch.column("size")), np.asarray(batch.column("rank"))
            sequence = np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                begin, share, base = places[int(s)]
                own = size == s
                at = np.searchsorted(begin, rank[own], side="right") - 1
                sequence[own] = base[at] + (rank[own] - begin[at]) // share[at]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence)], names=[*names, "sequence_id"])

    before = Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "size").orderBy("id", "start", "ids_crc32")
    # at most SHARDS * CAPACITY / STEP rows
    ranked = pieces.withColumn("within", F.row_number().over(within)).join(F.broadcast(offsets), ["size", "shard"]).withColumn("rank", (F.col("before") + F.col("within") - 1).cast("long"))
    placed = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "size", "rank").mapInArrow(place, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
