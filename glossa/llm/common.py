"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
import sys
import tempfile
import types
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def worker_slot(key: str, make: Callable):
    """An object that a Python worker keeps from task to task, until one of another key takes its place.

    There is one slot a worker, so that operators which follow one another don't add up their caches.
    """
    holder = sys.modules.setdefault("_glossa_worker", types.ModuleType("_glossa_worker"))
    if getattr(holder, "key", None) != key:
        holder.key, holder.value = key, None
        give_back()
        holder.value = make()
    return holder.value


def give_back() -> None:
    """Return freed memory to the system; an idle worker would hold it beside the steps that follow."""
    pa.default_memory_pool().release_unused()
    # only glibc has it, and it alone keeps so much
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(mapper: Callable) -> Callable:
    """An Arrow mapper of batches that returns its worker's freed memory when a task has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapper(batches)
        finally:
            give_back()

    return run


def release() -> None:
    """Drop what an operator before has kept in this worker."""
    worker_slot("", lambda: None)


#: rows of texts that go to Python at once, and their bytes (or one row)
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let at most BATCH_ROWS rows, and BATCH_BYTES unless the session has a limit, go to Python at once in this session.

    Whole texts are long rows and packed hashes longer ones: a batch stands in memory on both sides, beside the heap.
    """
    key, bytes_key = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    if bytes_key not in spark.conf.getAll:
        spark.conf.set(bytes_key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, to be read in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set one is made in local mode, and a cluster gets an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glossa-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The table, written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


def unused(name: str, names: list[str]) -> str:
    """``name``, or with marks put before it until no column has it (in any case)."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: ids of rows to drop are sent to all tasks only up to this many
MAX_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) the distinct ids of a checkpointed table of that one column; null equals null."""
    own = unused("id", docs.columns)
    ids = ids.toDF(own)
    return docs.join(F.broadcast(ids) if ids.count() <= MAX_IDS else ids, F.col(f"`{id_col}`").eqNullSafe(F.col(own)), how)


def without(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the ids of ``dropped``, a table of that one column; a null there drops the rows without an id."""
    return by_ids(docs, checkpointed(dropped.distinct()), id_col, "left_anti")


def once(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of those that repeat both id (or its absence) and text."""
    ids = checkpointed(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col))
    if ids.isEmpty():
        return docs
    return by_ids(docs, ids, id_col, "left_anti").unionByName(by_ids(docs, ids, id_col, "left_semi").dropDuplicates([id_col, text_col]))


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\x09-\\x0D."""
    return text.split() if text else []


#: odd multiplier of the Rabin-Karp polynomials, modulo 2**64
BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 4096)
            inverse = pow(BASE, -1, 1 << 64)
            up = np.full(m, BASE, dtype=np.uint64)
            down = np.full(m, inverse, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


def rolling(hashes: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` word hashes.

    Prefix sums of h[i] * BASE**-i, differenced and scaled back, give the
    polynomial of each window in constant time.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.get(len(hashes))
    prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * down, out=prefix[1:])
    return mixed((prefix[width:] - prefix[:-width]) * up[:n])


#: bytes of text that are hashed at once
PIECE = 1 << 17

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that lets any bits of a polynomial's value choose a bucket."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: words of more bytes are hashed by BLAKE2: sums modulo 2**64 can't tell some long patterned words apart
LONG_WORD = 256
#: values of bytes for a second, independent hash
OTHER_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of words, made for whole pieces of text by Rabin-Karp sums over their bytes.

    A word is a maximal run of bytes other than space and \\x09-\\x0D; words of more
    than LONG_WORD bytes have a digest instead.  With ``second`` each text gets two
    rows of hashes, made independently of each other.  Memory is bounded by PIECE and
    by eight bytes a word and row of one text.
    """

    def __init__(self, lower: bool, second: bool = False) -> None:
        release()
        self.same, self.powers, self.second = LOWER if lower else np.arange(256, dtype=np.uint8), Powers(), second
        self.values = [self.same.astype(np.uint64) + np.uint64(1), *([OTHER_VALUES[self.same]] if second else [])]

    def of_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The hashes of each text of a string or binary column; null: none."""
        column = column.cast(pa.binary())
        if column.null_count:
            column = column.fill_null(b"")
        n = len(column)
        if not n:
            return
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        at = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1, offset=4 * column.offset).astype(np.int64)
        i = 0
        while i < n:
            j = int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1
            if j > i:
                hashes, starts = self.piece(data[at[i] : at[j]], at[i : j + 1] - at[i])
                cuts = np.searchsorted(starts, at[i : j + 1] - at[i]).tolist()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield self.shaped(hashes[:, a:b])
                i = j
            else:
                yield self.shaped(self.long_text(data[at[i] : at[i + 1]]))
                i += 1

    def shaped(self, hashes: np.ndarray) -> np.ndarray:
        return hashes if self.second else hashes[0]

    def sums(self, data: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Prefix sums of each byte's value times BASE to minus its place."""
        terms = values[data]
        terms *= self.powers.get(len(data))[1]
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(terms, out=out[1:])
        return out

    def piece(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start of each word; texts: where a text starts (or ends), which parts words too."""
        if not len(data):
            return np.zeros((len(self.values), 0), dtype=np.uint64), np.zeros(0, dtype=np.int64)
        word, edge = ~SPACE[data], np.zeros(len(data) + 1, dtype=bool)
        edge[texts] = edge[0] = edge[-1] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~word[:-1]
        after[:-1] |= ~word[1:]
        starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        out = np.empty((len(self.values), len(starts)), dtype=np.uint64)
        for row, values in zip(out, self.values, strict=True):
            sums = self.sums(data, values)
            row[:] = mixed((sums[ends] - sums[starts]) * self.powers.get(len(data))[0][starts])
        for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            out[:, k] = self.digest([data[starts[k] : ends[k]]])
        return out, starts

    def digest(self, parts: Iterable[np.ndarray]) -> np.ndarray:
        """The hashes of a long word, given in parts."""
        found = hashlib.blake2b(digest_size=16)
        for part in parts:
            found.update(self.same[part].tobytes())
        return np.frombuffer(found.digest(), dtype=np.uint64)[: len(self.values)]

    def long_text(self, data: np.ndarray) -> np.ndarray:
        """A text of more than PIECE bytes, cut at white space."""
        out, at = [], 0
        while at < len(data):
            block = data[at : at + PIECE]
            if at + len(block) < len(data):
                spaces = np.flatnonzero(SPACE[block])
                if not len(spaces):
                    end = self.end_of_word(data, at)
                    out.append(self.digest(data[k : min(k + PIECE, end)] for k in range(at, end, PIECE))[:, None])
                    at = end
                    continue
                block = block[: spaces[-1] + 1]
            out.append(self.piece(block, np.zeros(1, dtype=np.int64))[0])
            at += len(block)
        return np.concatenate(out, axis=1)

    def end_of_word(self, data: np.ndarray, at: int) -> int:
        """Where a word that is longer than PIECE and starts at ``at`` ends."""
        while at < len(data):
            spaces = np.flatnonzero(SPACE[data[at : at + PIECE]])
            if len(spaces):
                return at + int(spaces[0])
            at += PIECE
        return len(data)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def per_row(fn: Callable[[bytes | None], tuple], fields: list[tuple[str, pa.DataType]], keep: list[str]):
    """An Arrow mapper that keeps some columns and adds ``fn(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(x) for x in texts_of(batch)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), *(pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields, strict=True))],
                names=[*keep, *(n for n, _ in fields)],
            )

    return run


def crc_fold(column: str, folds: int):
    """crc32 of a column as text, modulo ``folds`` (null: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)).cast("int")


def crc_fold_py(value, folds: int) -> int:
    return zlib.crc32(str(value).encode()) % folds
