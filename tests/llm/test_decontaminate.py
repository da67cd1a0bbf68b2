import math
import random
import re

import pytest

from glossa.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def brute(docs, items, share=0.7, run=13):
    """The rule, over every alignment that some seed confirms and those beside it."""
    best = {}
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    for d, t in docs:
        w = words(t)
        for i, q in items:
            v = words(q)
            short = ["1" * len(v)] if 0 < len(v) < 4 else decontaminate.SHORT_MASKS if 4 <= len(v) < 25 else []
            seeds = [(m, 8) for m in masks] + [([i for i, c in enumerate(m) if c == "1"], len(m)) for m in short]
            hit = lambda shift: any(all(w[shift + p + k] == v[p + k] for k in m) for m, n in seeds for p in range(len(v) - n + 1) if 0 <= shift + p and shift + p + n <= len(w))  # noqa: E731, B023
            hits = [shift for shift in range(1 - len(v), len(w)) if hit(shift)]
            top, union, longest = (-1, 0), set(), 0
            for shift in {x for h in hits for x in range(h - 3, h + 4)}:
                agree = [0 <= shift + p < len(w) and w[shift + p] == v[p] for p in range(len(v))]
                top = max(top, (sum(agree), -shift))
                inside = {p for s in range(len(v) - 7) if sum(agree[s : s + 8]) >= 6 for p in range(s, s + 8)}
                union |= {p for p in inside if agree[p]}
                n = 0
                for p in range(len(v)):
                    n = n + agree[p] if p in inside else 0
                    longest = max(longest, n)
            matched = max(top[0], len(union))
            if hits and (top[0] == len(v) or len(v) >= 8 and (matched >= share * len(v) or longest >= min(run, len(v)))):
                best[d, i] = max(best.get((d, i), (-1, 0)), (matched, top[1]))
    return {(d, i, -s, n) for (d, i), (n, s) in best.items()}


def found(spark, docs, items):
    got = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert all(abs(r.overlap - r.matched / r.item_words) < 1e-12 for r in got)
    return {(r.doc_id, r.item_id, r.place, r.matched) for r in got}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(2, 30)))) for i in range(24)]
    docs = []
    for d in range(40):
        own = [word() for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.7:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randrange(6)):
                leak[rng.randrange(len(leak))] = "changed"
            leak = leak[rng.randrange(3) :]
            at = rng.randrange(len(own) + 1)
            own[at:at] = leak
        docs.append((d, rng.choice([" ", ", ", "\n- "]).join(own).title()))
    return docs, items


@pytest.mark.parametrize("sent", [500_000, 0])
def test_equals_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "MAX_SENT", sent)
    docs, items = corpus(1)
    want = brute(docs, items)
    assert want and found(spark, docs, items) == want


def test_recall_at_the_edge_of_the_rule(spark):
    """As many substitutions at random places as 0.7 allows, 40 items of each length: 0.9 or more are found."""
    rng = random.Random(5)
    docs, items = [], []
    for n in range(8, 31):
        for k in range(40):
            item = [f"i{n}k{k}j{j}" for j in range(n)]
            items.append((100 * n + k, " ".join(item)))
            changed = set(rng.sample(range(n), n - math.ceil(0.7 * n - 1e-9)))
            docs.append((100 * n + k, " ".join(["before", *("other" if j in changed else w for j, w in enumerate(item)), "after"])))
    got = {(d, i) for d, i, *_ in found(spark, docs, items)}
    assert all(d == i for d, i in got)
    for n in range(8, 31):
        assert sum(d // 100 == n for d, _ in got) >= 36, n


def test_the_words_of_a_document_go_no_further_than_the_comparison(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_SENT", 0)
    docs, items = corpus(3)
    plan = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "collect_list" not in plan
    # the generator's unrequired columns: the document's words and the shifts
    dropped = [len(re.findall(r"\d+", x)) for line in plan.splitlines() if "Generate explode(transform(array_distinct" in line for x in re.findall(r"\[([\d, ]*)\], false, \[at#", line)]
    assert dropped == [2]


def test_a_substitution_in_every_window_is_tolerated(spark):
    item = [f"q{i}" for i in range(24)]
    leaked = [w if i % 7 != 3 else "other" for i, w in enumerate(item)]
    assert {(d, i) for d, i, *_ in found(spark, [(1, "before " + " ".join(leaked) + " after"), (2, "clean words only")], [(5, " ".join(item))])} == {(1, 5)}


@pytest.mark.parametrize(
    ("docs", "items"),
    [
        ([], [(1, "a b c d e f g h i")]),
        ([(1, "a b c d e f g h i")], []),
        ([(1, None), (2, ""), (3, "a b")], [(1, None), (2, ""), (3, "a b")]),
        ([(1, "a b c d e f g h i j")] * 2, [(1, "a b c d e f g h i j")] * 2),
        ([(1, "a " * 9)], [(1, "a " * 9)]),
        ([(1, "x " * 50000 + "a b c d e f g h")], [(4, "a b c d e f g h")]),
    ],
)
def test_edges(spark, docs, items):
    short = [(d, t) for d, t in docs if len(words(t)) < 1000]
    if short == docs:
        assert found(spark, docs, items) == brute(docs, items)
    else:
        assert {(d, i) for d, i, *_ in found(spark, docs, items)} == {(1, 4)}


def test_null_ids_extra_columns_and_native_plan(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h", 1, "s")], DOCS + ", item int, seed string")
    items = spark.createDataFrame([(None, "a b c d e f g h", 2)], ITEMS + ", place int")
    leaks = decontaminate.find_leaks(docs, items)
    assert [(r.doc_id, r.item_id, r.matched) for r in leaks.collect()] == [(None, None, 8)]
    plan = leaks._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def region_rule(docs, items, share=0.7, run=13):
    """Pairs leaked by the regions of any shift, by comparing all shifts."""
    out = set()
    for d, t in docs:
        w = words(t)
        for i, q in items:
            v, union, longest = words(q), set(), 0
            for shift in range(1 - len(v), len(w)):
                agree = [0 <= shift + p < len(w) and w[shift + p] == v[p] for p in range(len(v))]
                inside = {p for s in range(len(v) - 7) if sum(agree[s : s + 8]) >= 6 for p in range(s, s + 8)}
                union |= {p for p in inside if agree[p]}
                n = 0
                for p in range(len(v)):
                    n = n + agree[p] if p in inside else 0
                    longest = max(longest, n)
            if v and (len(union) >= share * len(v) or longest >= min(run, len(v))):
                out.add((d, i))
    return out


def test_a_shifted_copy_and_an_excerpt_are_found(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate([16, 17, 24, 40, 59])]
    filler = lambda: " ".join(f"f{rng.randrange(500)}" for _ in range(30))
    docs, want = [], set()
    for i, q in items:
        w = q.split()
        half = len(w) // 2
        for leak in (w[:half] + w[half + 1 :], w[:half] + ["new"] + w[half:], w[: max(13, len(w) * 65 // 100)], w[-13:], w[:8] + ["x"] + w[9:15]):
            want.add((len(docs), i))
            docs.append((len(docs), f"{filler()} {' '.join(leak)} {filler()}"))
        docs.append((len(docs), f"{filler()} {' '.join(w[:10])} {filler()}"))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want == region_rule(docs, items)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("sent", [500_000, 0])
def test_regions_cover_the_alignments_and_stay_in_the_rule(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "MAX_SENT", sent)
    docs, items = corpus(1)
    got = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    long = {i for i, q in items if len(words(q)) >= 8}
    assert {(r.doc_id, r.item_id) for r in got if r.item_id in long} <= {(d, i) for d, i, *_ in brute(docs, items)} | region_rule(docs, items)


def test_short_items_are_found(spark):
    items = [(1, "one"), (2, "two words"), (3, "a b c d e f g"), (4, "h i j k l m n o"), (5, "p q r s t u v w x y z 1")]
    docs = [(1, "x two words y"), (2, "two other words"), (3, "say a b c d e f g!"), (4, "a b c d e f x"), (5, "X i j k l m n o"), (6, "h i j k l m n X"), (7, "P q r s t u v w, x y z 1"), (8, "One, only")]
    assert {(d, i) for d, i, *_ in found(spark, docs, items)} == {(1, 2), (3, 3), (5, 4), (6, 4), (7, 5), (8, 1)}
