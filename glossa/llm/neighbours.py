"""Approximate nearest neighbours by a few stable projections and kd-trees.

Inner products become distances by one more component: with M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.
``projections`` Gaussian projections of x' make the index; for a point at
distance d the squared projected distance over d^2 is chi-square distributed.
A search takes the leaves of projected neighbours from near to far, verifies their
rows on the original vectors, and stops at a projected distance r where
chi2(r^2 / d_k^2) >= ``confidence``, d_k being the k-th best distance so far: each
true neighbour has then been seen with that probability, which is the recall to
be expected at least.  Only which rows are found is approximate, scores are exact.

Index: the cells of a kd-tree fitted on ``sample_rows`` vectors part the projected
space; a cell of more than ``block_rows`` rows is dealt by a hash of the id into
blocks, and every block has a kd-tree of its own.  Search: a query first visits
one block of its own cell, which bounds d_k, and then all blocks of the cells
that the stopping test lets it reach.  Queries of a block go in chunks of about
``chunk_rows``, whose queries visit a leaf together: one matrix product tells which
pairs can be among the best, and those alone are scored exactly.  Where vectors have
no near neighbours (as in check_l, where 0.78 of the rows are in reach) the pairs
are about queries times rows, at one product's cost each.  Counts a cell and the cells' boxes go through the driver; their
number is bounded by ``max_cells``.

Equal vectors have equal scores, so of the rows of one vector the k+1 with the
smallest ids decide; the others are left out before the index, as no answer can
hold them, and equal queries are searched once.

Defined cases: rows without id, and vectors that are null, empty, zero or hold
null or non-finite components take no part; shorter vectors count as padded with
zeros; ties go to the smaller id; a repeated candidate row is a candidate of its
own (unless all are of the query's id), a query id that repeats is one query (its
smallest vector); an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SCHEMA = "query_id long, rank int, vec_id long, score double"
#: rows of a leaf of a block's kd-tree
LEAF = 64


def chi2_cdf(x: float, m: int) -> float:
    """The chi-square distribution of an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(share: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, m) < share:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, m) < share else (low, middle)
    return high


class Tree:
    """A kd-tree: leaves are runs of ``order``; boxes are tight around the points."""

    def __init__(self, points: np.ndarray, leaf: int, max_leaves: int | None = None) -> None:
        self.points, self.order = points, np.arange(len(points))
        self.low, self.high, self.span, self.kids, self.cut = [], [], [], [], []
        todo, leaves = [self.node(0, len(points))], 1
        while todo:  # breadth first, so that a bound on leaves is met evenly
            i = todo.pop(0)
            (a, b), wide = self.span[i], self.high[i] - self.low[i]
            axis = int(wide.argmax())
            if b - a <= leaf or not wide[axis] > 0 or (max_leaves and leaves >= max_leaves):
                continue
            own = self.order[a:b].copy()
            value = np.median(points[own, axis])
            left = points[own, axis] < value
            if not left.any():
                left = points[own, axis] <= value
            self.order[a:b] = np.r_[own[left], own[~left]]
            self.cut[i] = (axis, points[own[~left], axis].min())
            self.kids[i] = (self.node(a, a + int(left.sum())), self.node(a + int(left.sum()), b))
            todo.extend(self.kids[i])
            leaves += 1

    def node(self, a: int, b: int) -> int:
        own = self.points[self.order[a:b]]
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.span.append((a, b))
        self.kids.append(None)
        self.cut.append(None)
        return len(self.span) - 1


def cells_of(points: np.ndarray, tree: Tree, number: dict[int, int]) -> np.ndarray:
    """The cell of each point, by the tree's cuts."""
    out, todo = np.zeros(len(points), dtype=np.int32), [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if tree.kids[node] is None:
            out[rows] = number[node]
            continue
        axis, value = tree.cut[node]
        right = points[rows, axis] >= value
        todo += [(tree.kids[node][0], rows[~right]), (tree.kids[node][1], rows[right])]
    return out


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, of equal rows equal to the last bit."""
    return (x * q).sum(axis=1)


def best_of(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best scores of each query, ties to smaller ids."""
    order = np.lexsort((ids, -scores, who))
    own = who[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    order = order[place < k]
    return who[order], ids[order], scores[order]


def search_block(tree: Tree, ids: np.ndarray, x: np.ndarray, q: np.ndarray, projected: np.ndarray, floor: np.ndarray, reach, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and scores of a block's best k rows for each.

    floor: k-th best scores known before; reach(floor): the squared projected distances at which those stop the search.
    """
    leaves = [n for n in range(len(tree.span)) if tree.kids[n] is None]
    away = np.stack([(np.maximum(np.maximum(tree.low[n] - projected, projected - tree.high[n]), 0) ** 2).sum(1) for n in leaves])
    floor, limit = floor.copy(), reach(floor)
    # more than the product's rounding
    slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    fresh: list[tuple[np.ndarray, ...]] = []
    waiting = 0
    for leaf in np.argsort(away.mean(1), kind="stable").tolist():
        near = np.flatnonzero(away[leaf] <= limit)
        if not len(near):
            continue
        a, b = tree.span[leaves[leaf]]
        rows = tree.order[a:b]
        could = q[near] @ x[rows].T >= (floor - slack)[near][:, None]
        at, of = np.nonzero(could)
        if not len(at):
            continue
        who, row = near[at], rows[of]
        scores = scores_of(q[who], x[row])
        fresh.append((who, ids[row], scores))
        waiting += len(who)
        if waiting > len(held[0]):  # twice as many each time
            held = list(best_of(*(np.concatenate(c) for c in zip(held, *fresh, strict=True)), k))
            fresh, waiting = [], 0
            last = np.flatnonzero(np.r_[held[0][1:] != held[0][:-1], True])
            full = last[np.bincount(held[0], minlength=len(q))[held[0][last]] == k]
            floor[held[0][full]] = np.maximum(floor[held[0][full]], held[2][full])
            limit = reach(floor)
    return best_of(*(np.concatenate(c) for c in zip(held, *fresh, strict=True)), k)


def unpacked(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, projections: int = 10, confidence: float = 0.97, sample_rows: int = 16384, block_rows: int = 8192, chunk_rows: int = 2048, max_cells: int = 1024, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: about the k rows of largest inner product with each query row (id divisible by ``every``)."""
    if projections % 2:
        raise ValueError("projections must be even")
    spark, most = vectors.sparkSession, k + 1
    real = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(real, lambda x: x != 0)
    every_row = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), real).alias("v")).dropna()
    # of equal vectors the smallest ids; Spark cuts the groups before it deals them
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = stored(every_row.withColumn("copy", copy).where(F.col("copy") <= most).select("id", "v", norm.alias("norm")))
    total, dim, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max("norm")).first()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    top = float(top)
    axes = np.random.default_rng(seed).standard_normal((dim + 1, projections))
    stop = chi2_quantile(confidence, projections)

    def matrix(column: pa.Array) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = np.asarray(column.value_lengths()).astype(np.int64)
        out = np.zeros((len(lengths), dim))
        out[np.arange(dim)[None, :] < lengths[:, None]] = np.asarray(column.flatten())
        return out

    def project(x: np.ndarray, point: bool) -> np.ndarray:
        rest = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0)) if point else 0.0
        return x @ axes[:-1] + np.multiply.outer(rest, axes[-1])

    share = min(1.0, sample_rows / total)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * sample_rows).toArrow()
    parts = min(max_cells, -(-total // block_rows))
    cuts = Tree(project(matrix(sample["v"]), True) if sample.num_rows else np.zeros((1, projections)), 1, parts)
    number = {node: i for i, node in enumerate(n for n in range(len(cuts.span)) if cuts.kids[n] is None)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            p = project(x, True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cells_of(p, cuts, number)), packed(x), packed(p)], names=["id", "cell", "x", "p"])

    index = stored(rows.select("id", "v").mapInArrow(indexed, "id long, cell int, x binary, p binary"))
    # one row a cell, at most max_cells: rows and the box of what it really holds
    boxes = index.mapInArrow(boxer(projections), "cell int, n long, low array<double>, high array<double>").groupBy("cell").agg(F.sum("n").alias("n"), F.array(*(F.min(F.col("low")[i]) for i in range(projections))).alias("low"), F.array(*(F.max(F.col("high")[i]) for i in range(projections))).alias("high")).orderBy("cell").toArrow()
    held, low, high = np.asarray(boxes["cell"]), np.array(boxes["low"].to_pylist()), np.array(boxes["high"].to_pylist())
    blocks = -(-np.asarray(boxes["n"]) // block_rows)
    asked = every_row.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = stored(asked)
    queries = stored(asked.groupBy("v").agg(F.min("id").alias("query")))

    def visits(first: bool):
        """Arrow mapper: a query to the cell nearest to it (one block), or to all blocks of the cells in reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = matrix(batch.column("v"))
                p, n = project(q, False), (q * q).sum(1)
                floor = np.full(len(q), -np.inf) if first else np.asarray(batch.column("floor").fill_null(-np.inf))
                out = []
                for i in range(len(q)):
                    d = (np.maximum(np.maximum(low - p[i], p[i] - high), 0) ** 2).sum(1)
                    if first:
                        out.append((i, int(d.argmin()), 0))
                    else:
                        limit = stop * max(n[i] + top * top - 2 * floor[i], 0) * (1 + 1e-9) + 1e-12
                        out += [(i, c, s) for c in np.flatnonzero(d <= limit).tolist() for s in range(blocks[c])]
                which, cell, block = (np.array(c, dtype=np.int64) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
                for a in range(0, len(which), 4096):
                    own = which[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(own)), pa.array(held[cell[a : a + 4096]].astype(np.int32)), pa.array(block[a : a + 4096].astype(np.int32)), packed(q[own]), packed(p[own]), pa.array(floor[own])], names=["query", "cell", "block", "q", "qp", "floor"])

        return run

    def search(found: pa.Table, sought: pa.Table) -> pa.Table:
        out = []
        if found.num_rows and sought.num_rows:
            ids, x = np.asarray(found["id"]), unpacked(found["x"], dim)
            tree = Tree(unpacked(found["p"], projections), LEAF)
            q, p, names = unpacked(sought["q"], dim), unpacked(sought["qp"], projections), np.asarray(sought["query"])
            size = (q * q).sum(1) + top * top
            who, got, scores = search_block(tree, ids, x, q, p, np.asarray(sought["floor"]), lambda floor: stop * np.maximum(size - 2 * floor, 0) * (1 + 1e-9) + 1e-12, most)
            out.append((names[who], got, scores))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query": columns[0], "vec_id": columns[1], "score": columns[2]})

    block_of = {int(c): int(b) for c, b in zip(held, blocks, strict=True)}

    def of_cell(values: dict[int, int]):
        """A number a cell as an expression; at most max_cells of them."""
        numbers = [values.get(c, 1) for c in range(len(number))]
        return F.get(F.array(*(F.lit(v) for v in numbers)), F.col("cell"))

    placed = index.withColumn("block", F.pmod(F.xxhash64("id"), of_cell(block_of)).cast("int"))

    def searched(sent: DataFrame, only_first: bool) -> DataFrame:
        """The best rows of each visit: a block's rows meet its queries, a chunk of them at a time."""
        counts = {r["cell"]: -(-r["n"] // chunk_rows) for r in sent.where("block = 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
        chunks = of_cell(counts)
        there = placed.where(F.col("cell").isin(sorted(counts))) if only_first else placed
        there = there.where("block = 0") if only_first else there
        there = there.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        sent = sent.withColumn("chunk", F.pmod(F.xxhash64("query"), chunks).cast("int"))
        keys = ["cell", "block", "chunk"]
        return there.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(search, "query long, vec_id long, score double")

    visit = "query long, cell int, block int, q binary, qp binary, floor double"
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = lambda df: df.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= most)
    near = searched(queries.select("query", "v").mapInArrow(visits(True), visit), True)
    floors = near.groupBy("query").agg(F.when(F.count(F.lit(1)) == most, F.min("score")).alias("floor"))
    sent = stored(queries.join(floors, "query", "left").select("query", "v", "floor").mapInArrow(visits(False), visit))
    answers = best(searched(sent, False)).groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score")).alias("found"))  # k + 1 at most
    told = asked.join(queries.join(answers, "query").select("v", "found"), "v").select(F.col("id").alias("query_id"), F.slice(F.filter(F.array_sort("found"), lambda f: f.vec_id != F.col("id")), 1, k).alias("found"))
    return told.select("query_id", F.posexplode("found").alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def boxer(projections: int):
    """Arrow mapper: rows and box of each cell in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes: dict[int, list] = {}
        for batch in batches:
            cells, p = np.asarray(batch.column("cell")), unpacked(batch.column("p"), projections)
            for c in np.unique(cells).tolist():
                own = p[cells == c]
                now = boxes.setdefault(c, [0, own[0], own[0]])
                boxes[c] = [now[0] + len(own), np.minimum(now[1], own.min(0)), np.maximum(now[2], own.max(0))]
        rows = [(c, n, a.tolist(), b.tolist()) for c, (n, a, b) in boxes.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["cell", "n", "low", "high"])

    return run
