import random

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import jaccard

SCHEMA = "doc_id long, text string"


def brute(rows, width, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    size = {}
    for i, x in sets:
        size[i] = max(size.get(i, 0), len(x))
    return {(i, size[i], find(i)) for i in top}


def found(spark, rows, width, num, den):
    return {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), width=width, num=num, den=den).collect()}


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(500)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("how", [(3, 90, 100), (5, 80, 100), (2, 1, 2)])
def test_equals_brute_force(spark, how):
    rng = random.Random(how[0])
    texts = sum((family(rng, rng.randrange(1, 14), rng.randrange(4, 120), 6) for _ in range(30)), [])
    texts += [t.upper() for t in texts[:10]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark, rows, *how) == brute(rows, *how)


def test_large_family_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "FIRST", 1)
    monkeypatch.setattr(jaccard, "MANY", 0)
    rng = random.Random(1)
    rows = list(enumerate(family(rng, 150, 100, 8) + family(rng, 60, 100, 3)))
    assert found(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_ngrams_closed_in_a_round_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FIRST", 1)
    monkeypatch.setattr(jaccard, "MANY", 0)
    rng = random.Random(9)
    # the families share a passage, so that texts of different ones meet too
    passage = " ".join(f"p{i}" for i in range(20))
    rows = list(enumerate(t + " " + passage * (k % 2) for k, t in enumerate(t for _ in range(12) for t in family(rng, 12, 60, 6))))
    for width, num in ((3, 90), (3, 70), (5, 80)):
        assert found(spark, rows, width, num, 100) == brute(rows, width, num, 100)
    monkeypatch.setattr(jaccard, "MAX_SENT", 0)
    assert found(spark, rows, 3, 80, 100) == brute(rows, 3, 80, 100)


def test_hot_ngrams_are_kept_whole(spark, monkeypatch):
    # workers get the module's functions by value, and with them these figures
    for name, value in (("BLOCK", 4), ("HOT", 8), ("BUCKET", 40), ("FLUSH", 100), ("FAN", 3), ("MANY", 0)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(6)
    rows = list(enumerate(family(rng, 40, 40, 3) * 2 + ["very common words " + t for t in family(rng, 30, 4, 4)] + family(rng, 25, 60, 4)))
    assert found(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)
    assert found(spark, rows, 1, 70, 100) == brute(rows, 1, 70, 100)


def test_links_survive_a_shuffled_send(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_SENT", 0)
    rng = random.Random(5)
    rows = list(enumerate(family(rng, 30, 60, 3)))
    assert found(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(20)][::-1]
    want = brute(rows, 1, 90, 100)
    assert found(spark, rows, 1, 90, 100) == want and {c for _, _, c in want} == {0}


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, "  \n")],
        [(1, "a"), (2, "A"), (3, "a b"), (4, "a  B"), (5, "a b c")],
        [(7, "same text of words")] * 3 + [(3, "same text of words")],
        [(1, "x y z q"), (1, "k l m n"), (2, "k l m n"), (0, "x y z q")],
        [(1, "w " * 30000), (2, "w " * 20000), (3, " ".join(map(str, range(20000))))],
    ],
)
def test_edges(spark, rows):
    assert found(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_null_ids_and_extra_columns(spark):
    rows = spark.createDataFrame([(None, "a b c d", 1, "p"), (2, "a b c d", 2, "q"), (1, "a b c d", 3, "r")], SCHEMA + ", rep int, hi string")
    assert {tuple(r) for r in jaccard.near_duplicates(rows, width=3).collect()} == {(1, 2, 1), (2, 2, 1)}


def test_filters_never_drop_a_link():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, jaccard.COUNTERS).astype(np.uint32)
    for _ in range(300):
        base = np.unique(rng.integers(0, 2**64, rng.integers(1, 80), dtype=np.uint64))
        drop = rng.random(len(base)) < 0.08
        x, y = base, np.unique(np.concatenate([base[~drop], rng.integers(0, 2**64, rng.integers(0, 4), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        p, q = (jaccard.prefix_of(s, counts, 80, 100)[0] for s in (x, y))
        shared = np.intersect1d(p, q)
        assert len(shared)
        rows = np.zeros(2, dtype=jaccard.POSTING)
        rows["n"], rows["pos"] = (len(x), len(y)), [np.flatnonzero(z == shared[0])[0] for z in (p, q)]
        assert jaccard.with_partner(rows, 80, 100).all()
        meeting = pa.table({"group": [0, 0], "visits": [False, True], "n": rows["n"], "pos": rows["pos"], "rep": [5, 6], "comp": [5, 6], "sketch": [jaccard.sketch(x), jaccard.sketch(y)], "key": [7, 7], "heads": [jaccard.heads_of([7, 9]), jaccard.heads_of([9, 7, 8])]})
        for nearest in (True, False):
            assert sum(len(x[0]) for x in jaccard.Meeting([meeting], 80, 100).pairs(nearest)) == 1


def test_postings_round_trip():
    rng = np.random.default_rng(1)
    for classes in (4, 70000):
        rows = np.zeros(100000, dtype=jaccard.POSTING)
        own = rng.integers(0, classes, len(rows))
        rows["key"], rows["pos"] = rng.integers(0, 2**48, len(rows)), rng.integers(0, 70000, len(rows))
        rows["hi"], rows["n"], rows["blocks"] = own * 7 - 2**62, own + 1, rng.choice([1, 1, 1, 5], len(rows))
        assert (jaccard.unpack(jaccard.pack(rows)) == rows).all()


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 5, 30, 500, 520, 1030, 2040, 9000, 40000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 2**64, n // 30, dtype=np.uint64)]))
        if len(y):
            assert jaccard.Sketches([jaccard.sketch(x), jaccard.sketch(y)]).apart(np.array([0]), np.array([1]))[0] <= len(np.setxor1d(x, y))


def test_pairs_of_a_meeting_are_those_of_two_loops():
    rng = np.random.default_rng(3)
    n = 400
    group, visits = np.sort(rng.integers(0, 40, n)), rng.random(n) < 0.4
    order = np.lexsort((visits, group))
    group, visits = group[order], visits[order]
    sets = [np.unique(rng.integers(0, 40, 30, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(n)]
    comp = rng.integers(0, 5, n)
    meeting = pa.table({"group": group, "visits": visits, "n": [len(x) for x in sets], "pos": [0] * n, "rep": np.arange(n), "comp": comp, "sketch": [jaccard.sketch(x) for x in sets], "key": group, "heads": [jaccard.heads_of([])] * n})
    for nearest in (True, False):
        got = {(a, b) for x, y, *_ in jaccard.Meeting([meeting], 1, 100).pairs(nearest) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        allowed = lambda i, j: (j < i if nearest else visits[i] and not visits[j])
        want = {(min(i, j), max(i, j)) for i in range(n) for j in range(n) if group[i] == group[j] and comp[i] != comp[j] and allowed(i, j)}
        assert got <= want and len(got) > 0.9 * len(want)


def test_pairs_are_told_at_their_first_common_head():
    row = lambda key: pa.table({"group": [0, 0], "visits": [False, True], "n": [9, 9], "pos": [0, 0], "rep": [1, 2], "comp": [1, 2], "sketch": [jaccard.sketch(np.arange(9, dtype=np.uint64))] * 2, "key": [key] * 2, "heads": [jaccard.heads_of([5, 3, 2]), jaccard.heads_of([9, 5, 3])]})
    assert [sum(len(x[0]) for x in jaccard.Meeting([row(k)], 90, 100).pairs(False)) for k in (2, 3, 5, 9)] == [1, 1, 0, 0]


def test_forest_is_a_least_one():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        u, v = rng.integers(0, 25, n), rng.integers(0, 25, n)
        a, b, d = rng.integers(0, 99, n), rng.integers(0, 99, n), rng.integers(0, 6, n)
        top = list(range(25))

        def find(x, top=top):
            return x if top[x] == x else find(top[x])

        cost = 0
        for k in np.argsort(d, kind="stable"):
            p, q = find(u[k]), find(v[k])
            if p != q:
                top[p], cost = q, cost + d[k]
        kept = jaccard.forest(a, b, d, u, v)
        assert d[kept].sum() == cost and len(kept) == 25 - len({find(x) for x in range(25)})


def test_stars_and_union_find_agree(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "u long, v long").selectExpr("least(u, v) as u", "greatest(u, v) as v").where("u <> v").distinct()
    assert sorted(map(tuple, jaccard.joined_in_task(edges).collect())) == sorted(map(tuple, jaccard.joined_by_stars(edges).collect()))


def test_texts_that_share_an_id_keep_the_links_of_each(spark):
    rng = random.Random(8)
    rows = []
    for k in range(0, 60, 3):
        one, other = (family(rng, 1, 60, 0)[0] for _ in range(2))
        rows += [(k, one), (k, other), (k + 1, one + " near"), (k + 2, other + " near")]
    got = found(spark, rows, 3, 90, 100)
    assert got == brute(rows, 3, 90, 100) and {c for _, _, c in got} == set(range(0, 60, 3))


def test_long_patterned_words_differ(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*words, word])), (2, " ".join([*words, word.translate(str.maketrans("ab", "ba"))])), (3, " ".join([*words, word.upper()]))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=90, den=100)
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 2, 3: 1}
