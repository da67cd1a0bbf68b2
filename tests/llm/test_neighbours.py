"""Nearest neighbours: recall and exact scores against brute force, ties, hot vectors, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import neighbours, queries


def brute(rows, every, k):
    """{query: [(id, score)]} of (id, vector) rows, by all pairs."""
    width = max((len(v) for _, v in rows), default=0)
    ids = np.array([i for i, _ in rows])
    x = np.array([list(v) + [0.0] * (width - len(v)) for _, v in rows], dtype=float).reshape(len(rows), width)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_chi_square():
    assert neighbours.chi2_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert neighbours.chi2_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)


def test_tree_keeps_every_point():
    points = np.random.default_rng(1).integers(0, 4, (500, 3)).astype(float)
    tree = neighbours.Tree(points, 8)
    leaves = [tree.span[i] for i in range(len(tree.span)) if tree.kids[i] is None]
    assert sorted(tree.order.tolist()) == list(range(500))
    assert sum(b - a for a, b in leaves) == 500
    number = {n: i for i, n in enumerate(n for n in range(len(tree.span)) if tree.kids[n] is None)}
    cells = neighbours.cells_of(points, tree, number)
    for node, i in number.items():
        a, b = tree.span[node]
        assert (cells[tree.order[a:b]] == i).all()


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding and any(r.embedding) and np.isfinite(r.embedding).all()]
    got, want = found(queries.op13_nearest_neighbours(spark, sf)), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    x = dict(rows)
    for q, r in got.items():
        assert len(r) == 20
        assert all(s == pytest.approx(float(np.dot(np.array(x[q], float), np.array(x[i], float))), abs=1e-12) for i, s in r)
        assert r == sorted(r, key=lambda p: (-p[1], p[0]))


def test_blocks_cells_and_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] * rng.uniform(0.5, 2) + 0.3 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(i, [1.0] * 16) for i in range(1500, 2200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(df, every=10, k=5, block_rows=100, chunk_rows=7, max_cells=8, sample_rows=300))
    want = brute(rows, 10, 5)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.95
    for q in range(1500, 2200, 10):
        assert got[q] == want[q]


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [2.0]), (3, None), (40, [0.0, 0.0]), (60, []), (None, [1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", F.lit("x")).withColumn("V", F.lit(1))
    assert found(neighbours.nearest(df)) == {0: [(8, 5.0), (20, 2.0)], 20: [(0, 2.0), (0, 2.0), (8, 2.0)]}
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 8")).count() == 0
    assert neighbours.nearest(df.where("vec_id = 20")).count() == 0


def test_a_blocks_queries_are_searched_together():
    """All rows in reach: the best k of each query with ties to smaller ids, and no score below what is known."""
    rng = np.random.default_rng(9)
    x = np.round(rng.standard_normal((700, 12)), 1)
    x[400:430] = x[7]
    ids, q = rng.permutation(700), np.r_[x[::70], x[7:8]]
    points, everything = x[:, :4].copy(), lambda floor: np.full(len(floor), np.inf)
    floor = np.where(np.arange(len(q)) % 3 == 0, (q * q).sum(1), -np.inf)
    who, got, scores = neighbours.search_block(neighbours.Tree(points, 16), ids, x, q, q[:, :4], floor, everything, 5)
    for i in range(len(q)):
        all_scores = neighbours.scores_of(q[i], x)
        want = [j for j in np.lexsort((ids, -all_scores)) if all_scores[j] >= floor[i]][:5]
        found = sorted(zip((-scores[who == i]).tolist(), got[who == i].tolist(), strict=True))
        assert [f for f in found if -f[0] >= floor[i]] == [(-float(all_scores[j]), int(ids[j])) for j in want]
