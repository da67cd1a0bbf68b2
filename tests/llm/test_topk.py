import math

import numpy as np

from glossa.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out, asked = set(), {}
    for i, v in usable:
        if i % every == 0:
            asked[i] = min(v, asked.get(i, v))
    for q, v in asked.items():
        ranked = sorted(((-dot(v, w), i) for i, w in usable if i != q))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)}
    return out


def found(spark, rows, **how):
    return {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), **how).collect()}


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i), (centres[i % 6] * rng.uniform(0.2, 2) + rng.normal(size=12) * 0.1).tolist()) for i in range(1500)]
    assert found(spark, rows, annulus=16, pivots=8, sample_rows=100) == brute(rows, 50, 5)


def test_query_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=5).tolist()) for i in range(400)]
    assert found(spark, rows, every=3, query_block=20) == brute(rows, 3, 5)


def test_ties_copies_nulls_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, [1.0]), (150, []), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [-0.001, 2.0]), (None, [9.0, 9.0])]
    rows += [(i, [0.5, 0.5]) for i in range(10, 40)] + [(12, [0.5, 0.5])]
    assert found(spark, rows) == brute(rows, 50, 5)


def test_few_and_no_rows(spark):
    assert found(spark, [(0, [1.0])]) == set()
    assert found(spark, [(0, [1.0]), (7, [2.0])]) == {(0, 1, 7, 256 * 512)}
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    assert found(spark, [(0, None)]) == set()


def test_large_components_are_exact(spark):
    rows = [(0, [1e7, 3.0]), (1, [1e7, 1.0]), (2, [1e7, 1.00390625])]
    assert found(spark, rows) == brute(rows, 50, 5)


def test_the_bound_prunes():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(4000, 3)))
    centre = np.zeros((1, 3))
    d = topk.distances(x, centre)[:, 0]
    order = np.argsort(d)
    best = topk.Best(np.array([-1]), np.array([-(2**63)]), 5)
    q = x[order[-1:]]
    done = topk.search_annuli(best, q, topk.distances(q, centre), 0, order.astype(np.int64), d[order], x[order], 64)
    assert done < 4000
    assert sorted(best.rows[:, 2].tolist()) == sorted(np.sort((x @ q[0]).astype(np.int64))[-5:].tolist())
