"""Exact top-k inner-product search with a pivot-distance index.

Index: every vector is keyed by its nearest pivot and its distance to it, and
the table is range-partitioned and sorted by that key, so that a run of rows is
an annulus around a pivot.  Pivots come from a bounded sample
(``sample_rows``); every row is indexed.

The index is written once and read for each block of queries.

Search: queries go in blocks of about ``query_block``, dealt by a hash of the id;
the driver holds one block at a time, and with more than one block each one's
result is written before the next is sent.  A query visits the annuli of a pivot from the one at its
own distance outwards, and stops where the triangle inequality says that no
score can reach its k-th best: for a row x of an annulus at least ``gap`` away,
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + |x|^2 - gap^2) / 2.
Scores against the sample give the first k-th best.  The result is exact.

Defined cases: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as padded with zeros; ties go to the
smaller id; a repeated candidate row is a candidate of its own, a query id that
repeats is one query (its smallest vector); a null id takes no part, an id that is
no whole number is an error; an empty table gives no rows; vectors are as
long as the longest; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SCALE = 256


def matrix(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """Rows of floor(scale * x) as float64 integers, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.floor(scale * np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64))
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    top = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * max(q.shape[1], 1)
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = lambda m: np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object)
    return np.clip(exact(q).dot(exact(x).T), -(2**63), 2**63 - 1).astype(np.int64)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T, 0))


class Best:
    """The best k of each query: (score, smaller id first)."""

    def __init__(self, query_ids: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.query_ids, self.kth, self.k = query_ids, floor.copy(), k
        self.rows = np.zeros((0, 3), dtype=np.int64)  # query index, id, score

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        a, b = np.nonzero((scores >= self.kth[which][:, None]) & (ids[None, :] != self.query_ids[which][:, None]))
        if not len(a):
            return
        rows = np.concatenate([self.rows, np.stack([which[a], ids[b], scores[a, b]], axis=1)])
        # ascending by query, descending by score (~ keeps the order at the type's limits), ascending by id
        rows = rows[np.lexsort((rows[:, 1], ~rows[:, 2], rows[:, 0]))]
        first = np.r_[True, rows[1:, 0] != rows[:-1, 0]] if len(rows) else np.zeros(0, bool)
        rank = np.arange(len(rows)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        self.rows = rows[rank < self.k]
        full = rows[rank == self.k - 1]
        self.kth[full[:, 0]] = np.maximum(self.kth[full[:, 0]], full[:, 2])


def search_annuli(best: Best, q: np.ndarray, q_dist: np.ndarray, pivot: int, ids: np.ndarray, dist: np.ndarray, x: np.ndarray, annulus: int) -> int:
    """Rows of one pivot in ascending distance; gives the scores computed."""
    starts = np.arange(0, len(ids), annulus)
    ends = np.minimum(starts + annulus, len(ids))
    low, high = dist[starts], dist[ends - 1]
    norm_q, norm_x = (q**2).sum(1), (x**2).sum(1).max(initial=0)
    d = q_dist[:, pivot]
    home = np.clip(np.searchsorted(low, d, side="right") - 1, 0, len(starts) - 1)
    done = 0
    for side in (0, 1, -1):
        at = home + side
        live = np.arange(len(q))
        while True:
            live = live[(at[live] >= 0) & (at[live] < len(starts))]
            if not len(live):
                break
            a = at[live]
            gap = np.maximum(np.maximum(d[live] - high[a], low[a] - d[live]), 0)
            # a little slack for the square roots
            reach = (norm_q[live] + norm_x - gap * gap * (1 - 1e-9)) / 2 + 1 >= best.kth[live]
            live, a = live[reach], a[reach]
            for block in np.unique(a):
                which = live[a == block]
                part = slice(starts[block], ends[block])
                best.add(which, ids[part], products(q[which], x[part]))
                done += len(which) * (ends[block] - starts[block])
            if side == 0:
                break
            at[live] += side
    return done


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: float = SCALE, pivots: int = 48, sample_rows: int = 4096, query_block: int = 16384, annulus: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of each query row (id divisible by ``every``)."""
    spark = vectors.sparkSession
    real = F.col("v").cast("array<double>")
    ok = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(ok, F.lit(False))).select("id", real.alias("v"))
    total, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    total, dim = total or 0, max(dim or 0, 1)
    schema = "query_id long, rank int, vec_id long, score long"
    if not total:
        return spark.createDataFrame([], schema)

    share = min(1.0, sample_rows / total)
    sampled = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample_rows).toArrow()
    seen_ids, seen = np.asarray(sampled["id"]), matrix(sampled["v"], dim, scale)
    centres = choose_pivots(seen, pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim, scale)
            d = distances(x, centres)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "pivot", "dist", "x"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = stored(rows.mapInArrow(keyed, "id long, pivot int, dist double, x binary").repartitionByRange(parts, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist"))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = -(-asked.count() // query_block)
    if blocks > 1:
        asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartitionByRange(parts, "block", "id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = None
    for i in range(blocks):
        block = (asked.where(F.col("block") == i) if blocks > 1 else asked).select("id", "v").toArrow()
        q_ids, q = np.asarray(block["id"]), matrix(block["v"], dim, scale)
        if not len(q_ids):
            continue
        start = Best(q_ids, np.full(len(q_ids), -(2**63)), k)
        for a in range(0, len(q), 1024):
            start.add(np.arange(a, min(a + 1024, len(q))), seen_ids, products(q[a : a + 1024], seen))
        sent = spark.sparkContext.broadcast((q_ids, q, distances(q, centres), start.kth))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q, q_dist, floor = sent.value
            best = Best(q_ids, floor, k)
            for batch in batches:
                ids, near, dist = (np.asarray(batch.column(c)) for c in ("id", "pivot", "dist"))
                if not len(ids):
                    continue
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float64).reshape(len(ids), dim)
                cuts = np.r_[0, np.flatnonzero(np.diff(near)) + 1, len(ids)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    search_annuli(best, q, q_dist, int(near[a]), ids[a:b], dist[a:b], x[a:b], annulus)
            r = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[r[:, 0]]), pa.array(r[:, 1]), pa.array(r[:, 2])], names=["query_id", "vec_id", "score"])

        got = index.mapInArrow(search, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            got = stored(got)
            sent.unpersist()
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], schema)
    return found


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
