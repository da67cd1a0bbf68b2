"""Removal of repeated passages: Rabin-Karp hashes of every token window.

Every window of ``window`` consecutive words is hashed, to 64 and 16 bits that
come from two independent hashes of its words: by chance about n**2 / 2**81 of the pairs among n distinct windows are taken for equal.  A
map task first settles the windows that repeat among its own documents and sends
one entry a distinct hash onwards, so that no passage, however common, sends more
than one entry a task.  Entries meet by hash bucket; each reply names a document
and its windows that also start in a document with a smaller id.  Replies and
documents meet by a hash of id and text, in parts of bounded size, where removed
windows merge into maximal intervals.

What is shuffled: about ten bytes a distinct window and task, the replies, and
the texts once.

Defined cases: a word is a run of bytes other than space and \\x09-\\x0D; null
and empty texts have no words; texts shorter than a window lose nothing; rows
that share a doc_id count as one document for "smaller id", so repeated rows and
ids that tie remove nothing from one another; a row with a null doc_id is kept
whole and removes nothing elsewhere; an id that is no whole number is an error; an
empty table gives none; a very long text is hashed in pieces and takes some tens
of bytes a word; other columns are kept, whatever their names, but for n_words,
n_removed and removed, which are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, Powers, WordHashes, give_back, rolling, texts_of, tidy, unused

#: windows that a map task holds at once, and those aimed at for a bucket
FLUSH, BUCKET = 1_000_000, 1_000_000

#: bytes of packed rows that a task gives at once, and documents that are cut at once
PACKED, SLICE = 1 << 20, 256

#: rows between tasks; kind 0: hashes to compare, 1: word intervals already settled, with the digest of their text, 2: hashes settled by a bucket (1 and 2 for a part of the documents)
ROW = [("bucket", pa.int32()), ("kind", pa.int8()), ("part", pa.int32()), ("keys", pa.binary()), ("who", pa.binary())]
ROW_DDL = "bucket int, kind tinyint, part int, keys binary, who binary"

#: a document as it is named between tasks: its id, and a byte of its text so that rows of one id spread
NAME = np.dtype([("id", np.int64), ("tag", np.uint8)])


def part_of(value: int, tag: int, parts: int) -> int:
    """The part of a document; ``part_column`` says the same in SQL."""
    return zlib.crc32(f"{value} {tag}".encode()) % parts


def part_column(value: Column, text: Column, parts: int) -> Column:
    """Documents without an id go by their text."""
    text = F.coalesce(text, F.lit("")).cast("binary")
    name = F.concat_ws(" ", value.cast("string"), F.pmod(F.crc32(text), F.lit(256)).cast("string"))
    return F.pmod(F.when(value.isNull(), F.crc32(text)).otherwise(F.crc32(name.cast("binary"))), F.lit(parts)).cast("int")


def window_hashes(words: np.ndarray, window: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """64 and 16 bits of each window, from two hashes a word."""
    return rolling(words[0], window, powers), (rolling(words[1], window, powers) >> np.uint64(48)).astype(np.uint16)


def addressed(names: np.ndarray, values: np.ndarray, kind: int, parts: int, bits: int) -> list[tuple]:
    """Rows for the parts of some documents; names sorted, a value (or a text's digest and an interval) for each."""
    cuts = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1, len(names)] if len(names) else np.array([0])
    owners, counts = names[cuts[:-1]], np.diff(cuts)
    part = np.array([part_of(*x, parts) for x in owners.tolist()], dtype=np.int64)
    rows = []
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        data = np.concatenate([values[cuts[k] : cuts[k + 1]] for k in own])
        head = np.r_[len(own), owners["id"][own], owners["tag"][own].astype(np.int64), counts[own]].astype(np.int64)
        rows.append((int(p) % (1 << bits), kind, int(p), data.tobytes(), head.tobytes()))
    return rows


def delivered(kind: int, keys: bytes, who: bytes) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """(document's name, its values) of an addressed row."""
    head = np.frombuffer(who, dtype=np.int64)
    n = int(head[0])
    values = np.frombuffer(keys, dtype=np.uint64) if kind == 2 else np.frombuffer(keys, dtype=np.int32).reshape(-1, 4)
    ids, tags, counts = head[1:].reshape(3, n)
    ends = np.cumsum(counts)
    for i, t, a, b in zip(ids.tolist(), tags.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
        yield (i, t), values[a:b]


def text_digest(text: bytes) -> np.ndarray:
    """64 bits, as two of 32, that tell rows of one id apart."""
    return np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), dtype=np.int32)


def planes(values: np.ndarray, drop: int = 0) -> bytes:
    """Integers byte by byte, the highest first, without the first ``drop`` bytes."""
    size = values.dtype.itemsize
    return np.ascontiguousarray(values.astype(f">u{size}").view(np.uint8).reshape(-1, size)[:, drop:].T).tobytes()


def unplanes(data: np.ndarray, n: int, kind, drop: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((n, size), dtype=np.uint8)
    out[:, drop:] = data.reshape(size - drop, n).T
    return out.view(f">u{size}").ravel().astype(kind)


def send(keys: np.ndarray, extra: np.ndarray, who: np.ndarray, names: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows for hashes; who: an index into names, sorted by id, for each.  Sorted hashes are not copied but a bucket at a time."""
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, extra, who = keys[order], extra[order], who[order]
    drop, a = bits // 8, 0
    while a < len(keys):
        bucket = int(keys[a]) >> (64 - bits)
        b = int(np.searchsorted(keys, np.uint64(((bucket + 1) << (64 - bits)) - 1), side="right"))
        order = a + np.argsort(who[a:b], kind="stable")
        own, counts = np.unique(who[a:b], return_counts=True)
        ids = names["id"][own]
        # gaps between ids, modulo 2**64, are short
        gaps = np.diff(ids.view(np.uint64), prepend=np.uint64(0))
        head = np.array([len(own), b - a], dtype=np.int64).tobytes()
        yield bucket, 0, 0, planes(keys[order], drop) + planes(extra[order]), head + planes(gaps) + names["tag"][own].tobytes() + planes(counts.astype(np.uint32))
        a = b


def receive(bucket: int, keys: bytes, who: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (64 and 16 bits) and the documents' names."""
    m, n = np.frombuffer(who, dtype=np.int64, count=2).tolist()
    drop, rest, data = bits // 8, np.frombuffer(who, dtype=np.uint8, offset=16), np.frombuffer(keys, dtype=np.uint8)
    names = np.empty(m, dtype=NAME)
    names["id"] = np.cumsum(unplanes(rest[: 8 * m], m, np.uint64), dtype=np.uint64).view(np.int64)
    names["tag"] = rest[8 * m : 9 * m]
    counts = unplanes(rest[9 * m :], m, np.uint32)
    own = unplanes(data[: (8 - drop) * n], n, np.uint64, drop) | np.uint64((bucket << (64 - bits)) & (((1 << (8 * drop)) - 1) << (64 - 8 * drop)))
    return own, unplanes(data[(8 - drop) * n :], n, np.uint16), np.repeat(names, counts)


def intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal [start, end) intervals of the words that windows at sorted starts cover."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    cut = np.flatnonzero(np.diff(starts) > window)
    return np.stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + window], axis=1)


def joined(spans: np.ndarray) -> np.ndarray:
    """Union of intervals."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(spans[1:, 0] > ends[:-1])
    return np.stack([spans[np.r_[0, cut + 1], 0], ends[np.r_[cut, len(spans) - 1]]], axis=1)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(ROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, ROW, strict=True)], names=[n for n, _ in ROW])


def in_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about PACKED bytes, each made when it is asked for."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + len(row[4])
        if size >= PACKED:
            yield as_batch(held)
            held, size = [], 0
    if held:
        yield as_batch(held)


def by_hash(keys: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by both hashes, and where in it a new one starts."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    again = np.flatnonzero(same)
    if (extra[order[again + 1]] != extra[order[again]]).any():
        order = np.lexsort((extra, keys))
        k, e = keys[order], extra[order]
        same = (k[1:] == k[:-1]) & (e[1:] == e[:-1])
    return order, np.r_[True, ~same] if len(k) else np.zeros(0, bool)


def settle(names: np.ndarray, found: list[tuple], digests: list[np.ndarray], window: int, bits: int, parts: int) -> Iterator[tuple]:
    """Rows to send for the windows of some documents.

    Arrays of all windows follow one another: what they take at once stands beside the executor's heap.
    """
    by_id = np.lexsort((names["tag"], names["id"]))
    names = names[by_id]
    lengths = np.array([len(found[i][0]) for i in by_id])
    keys, extra = (np.concatenate([found[i][c] for i in by_id]) for c in (0, 1))
    found.clear()
    order, first = by_hash(keys, extra)
    keys = keys[order]
    extra = extra[order]
    doc = np.repeat(np.arange(len(by_id), dtype=np.int32), lengths)[order]
    place = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])[order]
    del order
    rank = np.cumsum(np.r_[False, names["id"][1:] != names["id"][:-1]], dtype=np.int32)
    late = rank[doc] > rank[doc[first]][np.cumsum(first, dtype=np.int32) - 1]
    # rows of one id are answered by tag
    tag = names["tag"][doc]
    sent = first | (~late & np.r_[True, tag[1:] != tag[:-1]]) if len(doc) else first
    del first, tag
    place, of_late = place[late], doc[late]
    keys = keys[sent]
    extra = extra[sent]
    doc = doc[sent]
    del sent, late
    yield from send(keys, extra, doc, names, bits)
    del keys, extra
    doc = of_late
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(doc)) + 1, len(doc)] if len(doc) else [0]
    spans = [intervals(place[a:b].astype(np.int64), window).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if spans:
        sizes = [len(x) for x in spans]
        # rows that share an id have their own indices
        owners = np.repeat(names[doc[cuts[:-1]]], sizes)
        of = np.repeat(np.stack([digests[by_id[d]] for d in doc[cuts[:-1]]]), sizes, axis=0)
        yield from addressed(owners, np.concatenate([of, np.concatenate(spans)], axis=1), 1, parts, bits)


def removals(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """What is to be removed from documents, addressed to their parts, and the number of parts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, int(np.ceil(np.log2(max(size / 6 / BUCKET, 1)))))
    parts = int(min(1 << bits, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // (2 * BUCKET))))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(lower=False, second=True), Powers()
        names: list[tuple] = []
        held: list[tuple] = []
        digests: list[np.ndarray] = []
        n = 0

        def close() -> Iterator[pa.RecordBatch]:
            yield from in_batches(settle(np.array(names, dtype=NAME), held, digests, window, bits, parts))
            names.clear()
            digests.clear()
            give_back()

        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            for k, (i, words) in enumerate(zip(batch.column("id").to_pylist(), hashes.of_column(text), strict=True)):
                if words.shape[1] >= window:
                    own = text[k].as_py()
                    names.append((i, zlib.crc32(own) & 255))
                    held.append(window_hashes(words, window, powers))
                    digests.append(text_digest(own))
                    n += words.shape[1]
                if n >= FLUSH:
                    yield from close()
                    n = 0
        if n:
            yield from close()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            k, e, who = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(k)
            again = np.r_[k[order][1:] == k[order][:-1], False]
            again[1:] |= again[:-1]
            order = order[again]  # hashes that stand alone have no reply
            k, e, who = k[order], e[order], who[order]
            order = np.lexsort((who["id"], e, k))
            k, e, who = k[order], e[order], who[order]
            first = np.r_[True, (k[1:] != k[:-1]) | (e[1:] != e[:-1])] if len(k) else np.zeros(0, bool)
            late = who["id"] > who["id"][first][np.cumsum(first) - 1]
            out.append((who[late], k[late]))

        def replies() -> list[tuple]:
            if not out:
                return []
            who, k = (np.concatenate(c) for c in zip(*out, strict=True))
            out.clear()
            order = np.lexsort((who["tag"], who["id"]))
            return addressed(who[order], k[order], 2, parts, bits)

        for batch in batches:
            passed = pc.not_equal(batch.column("kind"), 0)
            if settled := pc.sum(passed).as_py():
                yield batch.filter(passed)
            # hashes are read where they lie in the batch
            buckets, kinds, data_of, who_of = (batch.column(n) for n in ("bucket", "kind", "keys", "who"))
            for i in range(batch.num_rows if (settled or 0) < batch.num_rows else 0):
                if kinds[i].as_py():
                    continue
                b, data, who = buckets[i].as_py(), data_of[i].as_buffer(), who_of[i].as_buffer()
                if b != bucket and held:
                    close()
                    if sum(len(k) for _, k in out) > FLUSH:
                        yield from in_batches(replies())
                bucket = b
                held.append(receive(b, data, who, bits))
        if held:
            close()
        yield from in_batches(replies())

    sent = rows.mapInArrow(tidy(windows), ROW_DDL).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(tidy(compare), ROW_DDL).select("part", "kind", "keys", "who"), parts


def cut_text(text: bytes, spans: np.ndarray) -> bytes:
    """The text without the words of the intervals and the space after each."""
    word = ~SPACE[np.frombuffer(text, dtype=np.uint8)]
    starts = np.flatnonzero(word & np.r_[True, ~word[:-1]])
    out, done = [], 0
    for a, b in spans.tolist():
        out.append(text[done : starts[a]])
        done = int(starts[b]) if b < len(starts) else len(text)
    out.append(text[done:])
    return b"".join(out)


def remove_repeats(docs: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text cut, and n_words, n_removed, removed (word intervals).

    Columns of these three names in ``docs`` are replaced.
    """
    added = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    kept = [c for c in docs.columns if c not in {n for n, _ in added}]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    found, parts = removals(docs, window, id_col, text_col)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields])
    schema = schema.add("n_words", "long").add("n_removed", "long").add("removed", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    whole_id, part = unused("id", kept), unused("part", kept)

    def cut(rows: pa.Table, replies: pa.Table) -> pa.Table:
        hashes, powers = WordHashes(lower=False), Powers()
        settled: dict[tuple, list[np.ndarray]] = {}
        keys: dict[tuple, list[np.ndarray]] = {}
        for kind, data, who in zip(*(replies.column(c).to_pylist() for c in ("kind", "keys", "who")), strict=True):
            for name, values in delivered(kind, data, who):
                (settled if kind == 1 else keys).setdefault(name, []).append(values)
        done = []
        for batch in rows.to_batches(max_chunksize=SLICE) or [pa.RecordBatch.from_pylist([], schema=rows.schema)]:
            given = batch.column(text_col).cast(pa.string()).cast(pa.binary())
            texts, counts, gone, spans = [], [], [], []
            for i, text, words in zip(batch.column(whole_id).to_pylist(), given, hashes.of_column(given), strict=True):
                text = text.as_py()
                name = (i, zlib.crc32(text or b"") & 255)
                span = []
                if name in settled and text:
                    own = text_digest(text)
                    span = [x[(x[:, :2] == own).all(1), 2:].astype(np.int64) for x in settled[name]]
                if name in keys:
                    own = rolling(words, window, powers)
                    span.append(intervals(np.flatnonzero(np.isin(own, np.concatenate(keys[name]))), window))
                span = joined(np.concatenate(span)) if span else np.zeros((0, 2), dtype=np.int64)
                texts.append(cut_text(text, span) if len(span) else text)
                counts.append(len(words))
                gone.append(int((span[:, 1] - span[:, 0]).sum()))
                spans.append([{"start": a, "end": b} for a, b in span.tolist()])
            values = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), **dict(zip((n for n, _ in added), (pa.array(x, k) for x, (_, k) in zip((counts, gone, spans), added, strict=True)), strict=True))}
            names = [*kept, *(n for n, _ in added)]
            done.append(pa.RecordBatch.from_arrays([values[n] if n in values else batch.column(n) for n in names], names=names))
        return pa.Table.from_batches(done)

    def cut_part(rows: pa.Table, replies: pa.Table) -> pa.Table:
        try:
            return cut(rows, replies)
        finally:
            give_back()

    own_id = F.col(f"`{id_col}`").cast("long")
    placed = docs.withColumns({whole_id: own_id, part: part_column(own_id, F.col(f"`{text_col}`").cast("string"), parts)})
    return placed.groupBy(part).cogroup(found.groupBy("part")).applyInArrow(cut_part, schema)


SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM docs
), seqs AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM wins
), least AS (
  SELECT s, min(doc_id) AS m FROM seqs GROUP BY s
), gone AS (
  SELECT DISTINCT q.doc_id, q.p + o.k AS p FROM seqs q JOIN least USING (s), range(0, 13) o(k) WHERE q.doc_id > least.m
), left_over AS (
  SELECT d.doc_id, d.p, d.word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs) d ANTI JOIN gone g ON d.doc_id = g.doc_id AND d.p = g.p
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM left_over GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""
