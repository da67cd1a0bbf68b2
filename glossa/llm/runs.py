"""Maximal periodic runs of words, found on a harmonic grid.

For each period p the grid has the places 0, p, 2p, ...  A run of period p and
four periods or more holds three neighbouring pairs (jp, (j+1)p), so one of its
places is followed by three equal words at distance p.  At such places the run's
ends come from two longest common extensions of jp and (j+1)p, forward and
backward: range minima over the common prefixes of neighbours in the suffix
array, of the words and of the reversed words.  A stretch that several periods
give has the smallest as its period (the others are multiples of it).

Work is n log n in a text's words.  The texts of a batch that have such a place
share suffix arrays of about ``GROUP_WORDS`` words; a longer text has its own, of
some 250 bytes a word.  Nothing is shuffled.

Defined cases: a null or empty text has no words, no runs and an empty collapsed
text; ids play no part, so null and repeated ids are kept as they are; runs may
overlap, and a word goes if any of them repeats it; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, texts_of, unused, words_of

#: words of texts that share a suffix array
GROUP_WORDS = 1 << 18
#: places of the grid that are looked at in one step
GRID = 1 << 20
#: a run has at least this many periods; the grid's first look relies on it
PERIODS = 4

RUNS = "array<struct<start:long,length:long,period:long>>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (jp, p) of all periods up to n / PERIODS at which three more places follow, in steps."""
    p, top = 1, n // PERIODS
    while p <= top:
        last = min(top, p + max(GRID * p // n, 1) - 1)
        periods = np.arange(p, last + 1)
        counts = (n - 1) // periods - 2  # j + 3 is still a place
        steps = np.repeat(periods, counts)
        j = np.arange(len(steps)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield j * steps, steps
        p = last + 1


def candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grid whose word also stands one, two and three periods later."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at, p in grid(len(words)):
        for k in (1, 2, 3):
            same = words[at] == words[at + k * p]
            at, p = at[same], p[same]
        found.append((at, p))
    return np.concatenate([a for a, _ in found]), np.concatenate([p for _, p in found])


class Extensions:
    """Longest common extensions of places of a text that ends with a symbol of its own."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
        levels, width = [rank], 1
        while rank.max() < n - 1:  # prefix doubling
            key = rank.astype(np.int64) * (n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, dtype=np.int32)
            rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            levels.append(rank)
            width *= 2
        self.rank = rank
        suffixes = np.empty(n, dtype=np.int64)
        suffixes[rank] = np.arange(n)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(n, dtype=np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][a] == levels[k][b]
            common[1:] += same.astype(np.int32) << k
            a[same] += 1 << k
            b[same] += 1 << k
        del levels
        self.least = [common]
        while 2 << (len(self.least) - 1) <= n:
            half, now = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(now[:-half], now[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from places a and b on (unequal) are the same."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << k) + 1])
        return out


def runs_of(texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int) -> list[np.ndarray]:
    """For each (words, places, periods) its runs (start, length, period) by start, then period."""
    sizes = np.array([len(w) for w, _, _ in texts])
    starts = np.cumsum(np.r_[1, sizes + 1])[:-1]
    text = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    text[np.r_[0, starts + sizes]] = -1 - np.arange(len(texts) + 1)  # marks, each once
    for (words, _, _), s in zip(texts, starts, strict=True):
        text[s : s + len(words)] = words
    a = np.concatenate([at + s for (_, at, _), s in zip(texts, starts, strict=True)])
    p = np.concatenate([p for _, _, p in texts])
    own = np.repeat(np.arange(len(texts)), [len(at) for _, at, _ in texts])
    ahead = Extensions(text).of(a, a + p)
    back = Extensions(text[::-1]).of(len(text) - a, len(text) - a - p)
    length = ahead + back + p
    keep = length >= np.maximum(least, PERIODS * p)
    start, length, p, own = (a - back)[keep], length[keep], p[keep], own[keep]
    order = np.lexsort((p, length, start))
    start, length, p, own = start[order], length[order], p[order], own[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    found = np.stack([start - starts[own], length, p], axis=1)[first]
    own = own[first]
    found = found[np.lexsort((found[:, 2], found[:, 0], own))]
    return np.split(found, np.searchsorted(own, np.arange(1, len(texts))))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that a run repeats, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def batch_runs(texts: list[bytes | None], least: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs and collapsed text of each text, in order."""
    none = np.zeros((0, 3), dtype=np.int64)
    held: list[tuple[list[bytes], int | None]] = []
    open_ones: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, known = 0, {}

    def flush() -> Iterator[tuple[np.ndarray, bytes]]:
        found = runs_of(open_ones, least) if open_ones else []
        for words, at in held:
            runs = none if at is None else found[at]
            yield runs, collapsed(words, runs)

    for text in texts:
        words = words_of(text)
        if held and size + len(words) > GROUP_WORDS:
            yield from flush()
            held, open_ones, size, known = [], [], 0, {}
        numbers = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
        size += len(words)
        at, p = candidates(numbers)
        held.append((words, len(open_ones) if len(at) else None))
        if len(at):
            open_ones.append((numbers, at, p))
    yield from flush()


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6) -> DataFrame:
    """doc_id, runs (start and length in words, smallest period), collapsed text; a run has ``min_words`` and four periods at least."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            runs, kept = [], []
            for found, text in batch_runs(texts_of(batch), min_words):
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(search, f"doc_id {id_type}, runs {RUNS}, collapsed string")


def made_periodic(id_col: Column, text: Column) -> Column:
    """The text, or for ids whose crc32 is a multiple of ten, one that is periodic from some word on."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # one evaluation of words, n, a and p a row: they are bound by transforms of one-element arrays
    bound = F.struct(words.alias("w"), a.alias("a"), p.alias("p"))
    again = F.transform(F.array(bound), lambda b: F.array_join(F.transform(b.w, lambda w, i: F.when(i < b.a, w).otherwise(F.get(b.w, (b.a + (i - b.a) % b.p).cast("int")))), " "))[0]
    return F.when((h % 10 == 0) & (n > 0), again).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run and the checksums of ``find_runs``."""
    best = unused("best", found.columns)
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    rows = found.withColumn(best, longest)
    length, period = -F.col(f"{best}.less"), F.col(f"{best}.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col(f"{best}.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
