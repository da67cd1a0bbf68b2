"""N-gram Jaccard join by rare-first prefixes, with classes of linked documents.

1. Every document becomes a set of word n-gram hashes.  Equal sets share a
   class (a 128-bit digest), so copies are never compared.  The same pass
   counts n-grams over all documents in ``COUNTERS`` buckets, a table of fixed
   size whatever the corpus, and makes a sketch of each set (the parity of its
   hashes in at least as many cells as it has elements; two sets differ in at
   least as many elements as cells).  Bucket count, then hash, is the total order.
2. Each set is sorted rarest first.  Two sets that link share an n-gram of
   their prefixes, so prefixes meet by n-gram in buckets whose number follows the
   postings.  Length and position filters leave the classes with a partner.
   N-grams of ``HOT`` documents or more are spread over buckets and all kept.
3. Links that only confirm a component are not needed.  In up to ``ROUNDS``
   rounds, as long as they bring more than ``MANY`` links, classes of different components meet, in
   the first at ``FIRST`` of their shared n-grams (those of least hash, on which
   like sets agree), then at all, in blocks of about ``BLOCK`` classes, dealt anew
   in each round; the nearest pairs that span them (a least
   forest) are verified on whole sets and joined.  Then all pairs of all n-grams that pass length, position and
   suffix filter (the sketches) and are still in different components are
   verified, each once; an n-gram of one block of which no pair passed in a round
   that looked at all of it is not met again, as pairs only ever fall away: of the classes of an n-gram, those outside its largest
   component visit all blocks, and a pair that meets at several n-grams is told at
   the least of those that are among the ``HEADS`` least of both.  No link between different sets can be lost, and a
   group of n near copies costs about n verifications.
4. A pair is verified where the class with more pairs has its set; that one goes
   once to every ``FAN`` partners.

Defined cases: null and empty texts have no set and link with nothing; shorter
texts than an n-gram are one n-gram; rows that share a doc_id are one document
(its n_shingles is the largest, its links are those of all its rows); repeated
rows change nothing; sets that tie for nearest go by the smaller id; a null
doc_id yields no row, and an empty table none; an id that is no whole number is an
error; texts are hashed in pieces, so a very long one takes eight bytes a word; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Powers, WordHashes, checkpointed, discard, rolling, stored, tidy

COUNTERS, CHUNK, BLOCK, ROUNDS, FIRST, FAN = 1 << 22, 1 << 16, 2048, 4, 4, 256

#: occurrences that make an n-gram hot; postings that a map task holds, and those aimed at for a bucket
HOT, FLUSH, BUCKET = 1 << 14, 500_000, 500_000

#: links of a round that are worth another
MANY = 2000

#: cells of a sketch, least and most
LEAST_CELLS, MOST_CELLS = 64, 1 << 14

#: ids of fixed width are sent to all tasks, and links joined within one, only up to this many
MAX_SENT = 500_000


def grams(words: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text, given its words' hashes."""
    if not len(words):
        return words
    own = min(width, len(words))
    found = np.sort(rolling(words, own, powers) ^ np.uint64((width - own) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return found[np.r_[True, found[1:] != found[:-1]]]


def digest(found: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist())


def needed(a, b, num: int, den: int):
    """Least overlap of sets of a and b elements that link."""
    return -(-num * (a + b) // (num + den))


def prefix_of(found: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix, rarest first, and the counts of its elements."""
    n = len(found)
    size = n + (-num * n // den) + 1
    times = counts[found & np.uint64(COUNTERS - 1)]
    rank = (np.minimum(times, 65535).astype(np.uint64) << np.uint64(48)) | (found >> np.uint64(16))
    order = np.argsort(rank, kind="stable")[:size]
    return found[order], times[order]


#: key: the upper 48 bits of an n-gram's hash; hi: half of its class's digest; blocks: over which the n-gram's classes are dealt
POSTING = np.dtype([("key", np.int64), ("hi", np.int64), ("n", np.int32), ("pos", np.int32), ("blocks", np.int32)])
POSTING_DDL = "key long, hi long, n int, pos int, blocks int"


def pack(rows: np.ndarray) -> bytes:
    """Postings column by column, keys without their empty bytes; n and blocks go once a class and key."""
    names, index = np.unique(np.stack([rows["hi"], rows["n"].astype(np.int64)]), axis=1, return_inverse=True)
    small = index.astype(np.uint16 if names.shape[1] <= 65536 else np.uint32)
    wide = np.flatnonzero(rows["blocks"] > 1)
    planes = rows["key"].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].T
    head = np.array([len(rows), names.shape[1], small.itemsize, len(wide)], dtype=np.int64)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, planes, small, rows["pos"].astype("<i4").view(np.uint8).reshape(-1, 4).T, names[0], names[1].astype(np.int32), wide.astype(np.int32), rows["blocks"][wide]))


def unpack(data: bytes) -> np.ndarray:
    n, m, width, w = np.frombuffer(data, dtype=np.int64, count=4).tolist()
    place = 32

    def take(kind, count):
        nonlocal place
        out = np.frombuffer(data, dtype=kind, count=count, offset=place)
        place += out.nbytes
        return out

    out, keys = np.empty(n, dtype=POSTING), np.zeros((n, 8), dtype=np.uint8)
    keys[:, :6] = take(np.uint8, 6 * n).reshape(6, n).T
    index = take(np.uint16 if width == 2 else np.uint32, n)
    out["key"] = keys.view("<i8").ravel()
    out["pos"] = np.ascontiguousarray(take(np.uint8, 4 * n).reshape(4, n).T).view("<i4").ravel()
    out["hi"], out["n"] = take(np.int64, m)[index], take(np.int32, m)[index]
    out["blocks"] = 1
    wide = take(np.int32, w)
    out["blocks"][wide] = take(np.int32, w)
    return out


def within_bounds(nx, ny, ix, iy, num: int, den: int):
    """Whether sets of nx and ny elements that share the elements at places ix and iy can link, and how many elements may differ."""
    least = needed(nx, ny, num, den)
    ok = (np.minimum(nx, ny) * den >= np.maximum(nx, ny) * num) & (np.minimum(ix, iy) + 1 + np.minimum(nx - ix - 1, ny - iy - 1) >= least)
    return ok, nx + ny - 2 * least


def with_partner(every: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of postings sorted by key: which have another of their key within length and position bounds.

    Neighbours at growing distance are compared until both have a partner.
    Keys with more than BLOCK postings keep those not settled by then.
    """
    key = every["key"]
    start = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    size = np.diff(np.r_[np.flatnonzero(start), len(key)])
    left = np.repeat(np.flatnonzero(start) + size, size) - np.arange(len(key)) - 1 if len(key) else size  # postings of the key after this one
    keep = np.zeros(len(key), dtype=bool)
    at, d = np.flatnonzero(left > 0), 1
    while len(at) and d <= BLOCK:
        now = at[~(keep[at] & keep[at + d])]
        x, y = every[now], every[now + d]
        now = now[within_bounds(*(z[c].astype(np.int64) for c in ("n", "pos") for z in (x, y)), num, den)[0]]
        keep[now] = keep[now + d] = True
        d += 1
        at = at[left[at] >= d]
    return keep | (np.repeat(size, size) > BLOCK)


def sketch(found: np.ndarray) -> bytes:
    """Parity of the elements in each of some power of two of cells."""
    cells = min(max(LEAST_CELLS, 1 << (len(found) - 1).bit_length()), MOST_CELLS)
    odd = np.bincount(((found >> np.uint64(16)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of classes, compared at the coarser width of a pair."""

    def __init__(self, each: list[bytes]) -> None:
        self.width = np.array([len(x) // 8 for x in each], dtype=np.int64)
        self.place, self.table = {}, {}
        for w in np.unique(self.width).tolist():
            for level in (w, w // 2):
                own = np.flatnonzero((self.width == level) | (self.width == 2 * level))
                if level in self.table or not len(own):
                    continue
                self.place[level] = np.zeros(len(each), dtype=np.int64)
                self.place[level][own] = np.arange(len(own))
                rows = [np.frombuffer(each[c], dtype=np.uint64) for c in own.tolist()]
                # cells go by the low bits of a hash, so the halves fold
                self.table[level] = np.stack([x if len(x) == level else x[:level] ^ x[level:] for x in rows])

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """At least how many elements the classes x and y, pair by pair, differ in."""
        level = np.minimum(self.width[x], self.width[y])
        out = np.zeros(len(x), dtype=np.int64)
        for w in np.unique(level).tolist():
            # sets that can link are at most one width apart; others are left to the length filter
            at = np.flatnonzero((level == w) & (np.maximum(self.width[x], self.width[y]) <= 2 * w))
            t, p = self.table[w], self.place[w]
            step = max(1, (1 << 20) // w)
            for s in range(0, len(at), step):
                part = at[s : s + step]
                out[part] = np.bitwise_count(t[p[x[part]]] ^ t[p[y[part]]]).sum(1, dtype=np.int64)
        return out


#: of a class's shared n-grams, those of least hash, by which a pair's first meeting is told
HEADS = 8


class Meeting:
    """Classes that meet at n-grams: a row for each, sorted by group; the pairs that may link."""

    NAMES = ("group", "visits", "n", "pos", "rep", "comp", "sketch", "key", "heads")

    def __init__(self, rows: list[pa.Table], num: int, den: int) -> None:
        whole = pa.concat_tables(rows)
        self.group, visits, self.n, self.pos, self.rep, self.comp, _, self.key = (whole[c].to_numpy() if c != "sketch" else None for c in self.NAMES[:-1])
        self.heads = np.frombuffer(b"".join(whole["heads"].to_pylist()), dtype=np.int64).reshape(len(self.key), HEADS)
        self.visits = visits.astype(bool)
        self.sketches, self.num, self.den = Sketches(whole["sketch"].to_pylist()), num, den

    def met_before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the pairs also meet at a smaller n-gram that is a head of both, and so are looked at there."""
        out = np.zeros(len(x), dtype=bool)
        for s in range(0, len(x), 1 << 14):
            a, b, key = self.heads[x[s : s + (1 << 14)]], self.heads[y[s : s + (1 << 14)]], self.key[x[s : s + (1 << 14)]]
            same = (a[:, :, None] == b[:, None, :]).any(2) & (a >= 0) & (a < key[:, None])
            out[s : s + (1 << 14)] = same.any(1)
        return out

    def pairs(self, inside: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs of ids that pass all filters, in how many elements they differ at least, their components, and the n-gram.

        Inside, each row meets those before it in its group; else visitors meet the others.
        """
        start = np.r_[True, self.group[1:] != self.group[:-1]]
        first = np.flatnonzero(start)[np.cumsum(start) - 1]
        if inside:
            who, count = np.arange(len(first)), np.arange(len(first)) - first
        else:
            at = np.cumsum(~self.visits)
            hosts = at - at[first] + ~self.visits[first]  # hosts come before visitors
            who = np.flatnonzero(self.visits)
            count = hosts[who]
        ends = np.cumsum(count)
        a = 0
        while a < len(who):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 18), side="right")))
            times = count[a:b]
            x = np.repeat(who[a:b], times)
            y = np.repeat(first[who[a:b]], times) + np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times)
            a = b
            ok = self.comp[x] != self.comp[y]
            x, y = x[ok], y[ok]
            ok, room = within_bounds(*(z[i].astype(np.int64) for z in (self.n, self.pos) for i in (x, y)), self.num, self.den)
            x, y, room = x[ok], y[ok], room[ok]
            apart = self.sketches.apart(x, y)
            x, y, apart = (z[apart <= room] for z in (x, y, apart))
            if not inside:
                new = ~self.met_before(x, y)
                x, y, apart = x[new], y[new], apart[new]
            p, q = self.rep[x], self.rep[y]
            yield np.minimum(p, q), np.maximum(p, q), apart, self.comp[x], self.comp[y], self.key[x]


def heads_of(keys: list) -> bytes:
    """Some n-grams of a class in a row of fixed width, filled up with -1."""
    return np.array([*keys, *[-1] * (HEADS - len(keys))], dtype=np.int64).tobytes()


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) at distance d make a least spanning forest of their components u and v."""
    order = np.lexsort((b, a, d))
    nodes, index = np.unique(np.r_[u[order], v[order]], return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label, alive, kept = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        p, q = label[x[alive]], label[y[alive]]
        alive, p, q = (z[p != q] for z in (alive, p, q))
        if not len(alive):
            return order[np.unique(np.concatenate(kept))] if kept else order[:0]
        # the first pair of each component, as pairs go by distance
        best = np.full(len(nodes), len(a))
        for side in (p, q):
            first = np.full(len(nodes), len(a))
            first[side[::-1]] = alive[::-1]
            best = np.minimum(best, first)
        own = np.flatnonzero(best < len(a))
        kept.append(best[own])
        ends = label[x[best[own]]], label[y[best[own]]]
        to = np.arange(len(nodes))
        to[own] = np.where(ends[0] == own, ends[1], ends[0])
        # two that chose the same pair
        to = np.where((to[to] == np.arange(len(nodes))) & (np.arange(len(nodes)) < to), np.arange(len(nodes)), to)
        while (to != to[to]).any():
            to = to[to]
        label = to[label]


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable).

    Up to MAX_SENT distinct edges are joined by one task's union-find, more by
    alternating large and small stars.
    """
    edges = checkpointed(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
    return (joined_in_task if edges.count() <= MAX_SENT else joined_by_stars)(edges)


def joined_in_task(edges: DataFrame) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while top.setdefault(root, root) != root:
                root = top[root]
            while top[x] != root:
                top[x], x = root, top[x]
            return root

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = find(u), find(v)
                top[max(a, b)] = min(a, b)
        found = [(x, find(x)) for x in top]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, c in found if x != c], pa.int64()), pa.array([c for x, c in found if x != c], pa.int64())], names=["node", "comp"])

    return edges.coalesce(1).mapInArrow(tidy(join), "node long, comp long")


def joined_by_stars(now: DataFrame) -> DataFrame:
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("v").alias("node"), F.col("u").alias("comp"))
        seen = mark
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("x", "y")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        tied = large.join(low, "v")
        now = checkpointed(tied.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u <> v").union(low.select(F.col("m"), F.col("v"))).distinct())


def near_duplicates(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: classes of documents linked by a Jaccard similarity of num/den or more."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("id").isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers, counts = WordHashes(lower=True), Powers(), np.zeros(COUNTERS, dtype=np.uint32)
        names = ["id", "n", "hi", "lo", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        held: list[np.ndarray] = []
        n = 0

        def tally() -> None:
            cells = np.sort(np.concatenate(held) & np.uint64(COUNTERS - 1))
            held.clear()
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            counts[cells[starts].astype(np.int64)] += np.diff(np.r_[starts, len(cells)]).astype(np.uint32)

        for batch in batches:
            out = []
            for i, words in zip(batch.column("id").to_pylist(), hashes.of_column(batch.column("text")), strict=True):
                found = grams(words, width, powers)
                if len(found):
                    held.append(found)
                    n += len(found)
                    if n > FLUSH:
                        tally()
                        n = 0
                    out.append((i, len(found), *digest(found), sketch(found)))
                else:
                    out.append((i, 0, None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if held:
            tally()
        packed = [(c, zlib.compress(counts[c * CHUNK : (c + 1) * CHUNK].tobytes(), 1)) for c in range(COUNTERS // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
        if packed:
            salt = int(counts.sum()) % (1 << 20)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(packed), pa.int64()), pa.array([c for c, _ in packed], pa.int64()), pa.array([salt] * len(packed), pa.int64()), pa.nulls(len(packed), pa.int64()), pa.array([p for _, p in packed], pa.binary())], names=names)

    first = stored(rows.mapInArrow(tidy(count), "id long, n long, hi long, lo long, data binary"))
    sets = first.where("id is not null").select("id", "n", "hi", "lo")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(zlib.decompress(data), dtype=np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zlib.compress(np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes(), 1) for s in sums.values()], pa.binary())], names=["n", "data"])

    # counters of the tasks add up in two steps, in the first about the root of their number a group
    chunks = COUNTERS // CHUNK
    counted = first.where("id is null")
    groups = math.isqrt(counted.count() // chunks) + 1
    partial = counted.select("n", F.pmod("hi", F.lit(groups)).alias("hi"), "data").repartition(max(chunks, parts), "n", "hi").mapInArrow(tidy(total), "n long, data binary")
    counts = np.zeros(COUNTERS, dtype=np.uint32)  # a table of fixed size
    for r in partial.repartition(chunks, "n").mapInArrow(tidy(total), "n long, data binary").collect():
        counts[r.n * CHUNK : (r.n + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.data), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(counts)
    expected = sets.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    buckets = max(parts, int(expected // BUCKET))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers, counts = WordHashes(lower=True), Powers(), sent.value
        held, n, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            hot = every["blocks"] > HOT // BLOCK
            bucket = (every["key"] ^ np.where(hot, every["hi"] & 0xFFFFFFFF, 0)) % buckets
            order = np.lexsort((bucket, hot))
            every, bucket, hot = every[order], bucket[order], hot[order]
            cuts = np.r_[0, np.flatnonzero((np.diff(bucket) != 0) | (np.diff(hot.astype(np.int8)) != 0)) + 1, len(bucket)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(hot[cuts[:-1]], pa.bool_()), pa.array([pack(every[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["bucket", "hot", "data"])

        for batch in batches:
            for words in hashes.of_column(batch.column("text")):
                found = grams(words, width, powers)
                if not len(found) or (name := digest(found)) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(name)
                prefix, times = prefix_of(found, counts, num, den)
                out = np.empty(len(prefix), dtype=POSTING)
                out["key"], out["hi"], out["n"], out["pos"] = prefix >> np.uint64(16), name[0], len(found), np.arange(len(prefix))
                out["blocks"] = -(-times.astype(np.int64) // BLOCK)
                held.append(out)
                n += len(out)
                if n > FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def close() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every = every[np.lexsort((every["hi"], every["n"], every["key"]))]
            same = (every["key"][1:] == every["key"][:-1]) & (every["hi"][1:] == every["hi"][:-1]) & (every["n"][1:] == every["n"][:-1])
            every = every[np.r_[True, ~same]]
            m = every if now[1] else every[with_partner(every, num, den)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m[c])) for c in POSTING.names], names=list(POSTING.names))

        for batch in batches:
            for bucket, hot, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "hot", "data")), strict=True):
                # what is hot needs no partner, so a part of a bucket will do
                if held and ((bucket, hot) != now or hot and sum(map(len, held)) > 2 * BUCKET):
                    yield close()
                now = bucket, hot
                held.append(unpack(data))
        if held:
            yield close()

    sorted_out = rows.select("text").mapInArrow(tidy(postings), "bucket long, hot boolean, data binary").repartition(parts, "bucket").sortWithinPartitions("bucket", "hot")
    met = stored(sorted_out.mapInArrow(tidy(meet), POSTING_DDL))
    # an id with several texts stands for several classes, numbered by text
    numbered = F.row_number().over(Window.partitionBy("rep").orderBy("hi", "lo"))
    classes = stored(sets.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("rep")).withColumn("text_no", numbered))
    # half a digest picks its class, but for chance: then both stand for it
    active = checkpointed(met.select("hi").distinct().join(classes, "hi").select("rep", "text_no", "hi", "lo"))
    chosen = F.broadcast(active) if active.count() <= MAX_SENT else active
    sketches = stored(first.withColumnRenamed("id", "rep").join(chosen, ["rep", "hi", "lo"]).select("rep", "text_no", F.col("data").alias("sketch")).dropDuplicates(["rep", "text_no"]))
    nth = F.row_number().over(Window.partitionBy("rep", "text_no").orderBy("key"))
    shared = met.join(chosen, "hi").select("key", "n", "pos", "blocks", "rep", "text_no")
    is_hot = F.col("blocks") > HOT // BLOCK
    # hot postings of copies come from several tasks
    members = stored(shared.where(~is_hot).union(shared.where(is_hot).dropDuplicates(["rep", "text_no", "key"])).withColumn("nth", nth))
    discard(met)
    # n-grams of one block alone: who has one meets everyone else who has it
    heads = members.where((F.col("nth") <= HEADS) & (F.col("blocks") == 1)).groupBy("rep", "text_no").agg(F.sort_array(F.collect_list("key")).alias("heads"))
    sketched = sketches.join(heads, ["rep", "text_no"], "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<bigint>")))

    def verify(pairs: DataFrame) -> DataFrame:
        """Of pairs of ids (a, b) those of which any texts link."""
        pairs = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if pairs.isEmpty():
            return pairs
        degree = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k")))
        known = pairs.join(degree.toDF("a", "ka"), "a").join(degree.toDF("b", "kb"), "b")
        ordered = known.select(F.when(F.col("kb") > F.col("ka"), F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(F.col("kb") > F.col("ka"), F.col("a")).otherwise(F.col("b")).alias("leaf"), F.greatest("ka", "kb").alias("k"))
        ordered = ordered.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("k") / FAN)).cast("int").alias("salt"))
        goes = ordered.select(F.col("hub").alias("rep"), "hub", "salt", F.lit(None).cast("long").alias("leaf")).distinct().union(ordered.select(F.col("leaf").alias("rep"), "hub", "salt", "leaf"))
        wanted = checkpointed(goes.groupBy("rep").agg(F.collect_list(F.struct("hub", "salt", "leaf")).alias("goes")))
        asked = checkpointed(active.join(wanted.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.collect_set(F.struct("hi", "lo")).alias("names")).join(wanted, "rep"))
        if 2 * (asked.agg(F.sum(F.size("goes"))).first()[0] or 0) <= MAX_SENT:
            asked = F.broadcast(asked)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, powers = WordHashes(lower=True), Powers()
            kinds = [("hub", pa.int64()), ("salt", pa.int32()), ("leaf", pa.int64()), ("grams", pa.binary())]

            def batch_of(out: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

            for batch in batches:
                out, size = [], 0
                for names, goes, words in zip(batch.column("names").to_pylist(), batch.column("goes").to_pylist(), hashes.of_column(batch.column("text")), strict=True):
                    found = grams(words, width, powers)
                    if not len(found) or dict(zip(("hi", "lo"), digest(found), strict=True)) not in names:
                        continue
                    data = found.tobytes()
                    for x in goes:
                        out.append((x["hub"], x["salt"], x["leaf"], data))
                        size += len(data)
                        if size > 1 << 23:
                            yield batch_of(out)
                            out, size = [], 0
                if out:
                    yield batch_of(out)

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, hubs = None, {}
            for batch in batches:
                a, b = [], []
                for hub, salt, leaf, data in zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "leaf", "grams")), strict=True):
                    if (hub, salt) != at:
                        at, hubs = (hub, salt), {}
                    if leaf is None:
                        hubs[data] = np.frombuffer(data, dtype=np.uint64)
                        continue
                    y = np.frombuffer(data, dtype=np.uint64)
                    for x in hubs.values():
                        if not min(len(x), len(y)) * den >= max(len(x), len(y)) * num:
                            continue
                        both = np.sort(np.concatenate([x, y]))
                        shared = int((both[1:] == both[:-1]).sum())
                        if den * shared >= num * (len(x) + len(y) - shared):
                            a.append(hub)
                            b.append(leaf)
                            break
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        sets_sent = rows.join(asked, rows["id"] == asked["rep"]).select("names", "goes", "text").mapInArrow(tidy(send), "hub long, salt int, leaf long, grams binary")
        # a hub's own sets come before its leaves'
        return checkpointed(sets_sent.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("leaf").asc_nulls_first()).mapInArrow(tidy(check), "a long, b long").distinct())

    same_id = sets.where("n > 0").join(classes, ["hi", "lo"]).select("id", "rep")
    tied = same_id.groupBy("id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1).select("a", F.explode("reps").alias("b"))

    def proposed(comps: DataFrame, turn: int, going: DataFrame | None) -> DataFrame:
        """Pairs of classes of different components that pass the filters: a forest of the nearest, or (turn 0) all.

        Only n-grams of several blocks are met and those ``going`` (None: all).  After
        the first turn rows without a pair tell each n-gram at which any pair passed.
        """
        looked = members.where(F.col("nth") <= FIRST) if turn == 1 else members
        if going is not None:
            keys = F.broadcast(going) if going.count() <= MAX_SENT else going
            looked = looked.where("blocks > 1").unionByName(looked.where("blocks = 1").join(keys, "key", "left_semi"))
        placed = looked.join(comps, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "rep")).drop("node")
        placed = placed.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("blocks")).cast("int"))
        alone = {"host": F.col("own"), "guest": F.lit(0), "visits": F.lit(False)}
        if turn == 1:
            seated = placed.withColumns(alone)
        else:
            placed = checkpointed(placed)
            by_comp = placed.groupBy("key", "blocks", "comp").agg(F.count(F.lit(1)).alias("k"))
            open_keys = by_comp.groupBy("key", "blocks").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.max("k").alias("most"), F.sum("k").alias("all"))
            outside = F.col("all") - F.col("most")
            open_keys = open_keys.where(outside > 0).select("key", "blocks", "top", F.ceil(outside / BLOCK).cast("int").alias("seats"))
            open_keys = open_keys.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            open_rows = placed.join(open_keys, ["key", "blocks", "own"])
            if turn:
                seated = open_rows.withColumns(alone)
            else:
                hosts = open_rows.withColumns({"host": F.col("own"), "guest": F.explode(F.sequence(F.lit(0), F.col("seats") - 1)), "visits": F.lit(False)})
                guests = open_rows.where("comp <> top").withColumns({"host": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "guest": F.pmod(F.xxhash64("rep"), F.col("seats")).cast("int"), "visits": F.lit(True)})
                seated = hosts.unionByName(guests)
        # only what visits asks for heads
        known = sketches.withColumn("heads", F.array().cast("array<bigint>")) if turn else sketched
        seated = seated.join(known, ["rep", "text_no"]).select("key", "host", "guest", "visits", "n", "pos", "rep", "comp", "sketch", "heads")

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            found: list[tuple] = []
            passed: list[np.ndarray] = []

            def reduced() -> tuple:
                a, b, d, u, v = (np.concatenate(c) for c in zip(*found, strict=True))
                found.clear()
                if turn:
                    ok = forest(a, b, d, u, v)
                else:
                    order = np.lexsort((b, a))
                    ok = order[np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]] if len(a) else order
                return a[ok], b[ok], d[ok], u[ok], v[ok]

            def close() -> None:
                for *x, key in Meeting(held, num, den).pairs(bool(turn)):
                    found.append(tuple(x))
                    if turn > 1:
                        passed.append(np.unique(key))
                    if sum(len(f[0]) for f in found) > 500_000:
                        found.append(reduced())
                held.clear()

            def out() -> pa.RecordBatch:
                a, b = reduced()[:2]
                keys = np.unique(np.concatenate(passed)) if passed else a[:0]
                passed.clear()
                columns = [pa.concat_arrays([pa.array(c, pa.int64()), pa.nulls(len(keys), pa.int64())]) for c in (a, b)]
                return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(keys, pa.int64())])], names=["a", "b", "key"])

            rows_held, last = 0, None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                if not len(t):
                    continue
                key, host, guest = (t[c].to_numpy() for c in ("key", "host", "guest"))
                change = np.r_[last is None or last != (key[0], host[0], guest[0]), (key[1:] != key[:-1]) | (host[1:] != host[:-1]) | (guest[1:] != guest[:-1])]
                last = key[-1], host[-1], guest[-1]
                # groups are whole up to the last change
                cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
                base = int(held[-1]["group"][-1].as_py()) if held else -1
                t = t.append_column("group", pa.array(base + np.cumsum(change)))
                t = t.set_column(t.schema.get_field_index("heads"), "heads", pa.array([heads_of(h) for h in t["heads"].to_pylist()], pa.binary())).select(list(Meeting.NAMES))
                if change.any() and rows_held + cut > 20_000:
                    held.append(t.slice(0, cut))
                    close()
                    held.append(t.slice(cut))
                    rows_held = len(t) - cut
                    if sum(len(f[0]) for f in found) + sum(map(len, passed)) > 300_000:
                        yield out()
                else:
                    held.append(t)
                    rows_held += len(t)
            if held:
                close()
            if found:
                yield out()

        return seated.repartition(parts, "key", "host", "guest").sortWithinPartitions("key", "host", "guest", "visits").mapInArrow(tidy(across), "a long, b long, key long")

    comps = checkpointed(components(tied))
    turn, going = 1, None
    while True:
        told = checkpointed(proposed(comps, turn, going))
        if turn > 1:
            going = checkpointed(told.where("key is not null").select("key").distinct())
        found = verify(told.where("a is not null"))
        links = found.count()
        if links:
            comps = checkpointed(components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(found)))
        if not turn:
            break
        turn = turn + 1 if links > MANY and turn < ROUNDS else 0
    discard(members, sketches)
    named = sets.join(classes, ["hi", "lo"], "left").join(comps, F.col("rep") == F.col("node"), "left")
    return named.groupBy("id").agg(F.max("n").alias("n_shingles"), F.coalesce(F.min(F.coalesce("comp", "rep")), F.first("id")).alias("component_id")).select(F.col("id").alias(id_col), "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM docs WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y WHERE 100 * c >= 90 * (m.n + n.n - c)
), both_ways AS MATERIALIZED (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON r.other = b.x
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""
