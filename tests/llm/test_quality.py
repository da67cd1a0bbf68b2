import math
import random

import numpy as np

from glossa.llm import quality
from glossa.llm.common import crc_fold_py

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def corpus(n=900, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.2
        if bad:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "###" for w in words] if kind == 1 else [w for w in words[:10] for _ in range(9)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    known = [x for x in labels if x[0] % 2]
    got = quality.score_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(known, LABELS)).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs if crc_fold_py(i, 3) == 1}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(200)
    flipped = [(i, 1 - y if crc_fold_py(i, 3) == 1 else y) for i, y in labels]
    a, b = (sorted(map(tuple, quality.score_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, LABELS)).collect())) for x in (labels, flipped))
    assert a == b


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " "), (None, "x"), (4, "a"), (4, "a"), (5, "word " * 60000)]
    rows = spark.createDataFrame(docs, DOCS)
    for labels in ([], [(4, None), (None, 1)], [(4, 1), (4, 0), (5, 1)], [(5, 1), (5, 1)]):
        got = quality.score_quality(rows, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1)], LABELS)).collect() == []


def test_keep_good_keeps_columns(spark):
    docs, labels = corpus()
    rows = spark.createDataFrame([(i, t, "s", i) for i, t in docs], DOCS + ", features string, score long")
    kept = quality.keep_good(rows, spark.createDataFrame(labels, LABELS))
    assert kept.columns == rows.columns and 680 < kept.count() < 790
    assert quality.keep_good(rows.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_the_risk_separates_and_the_prior_is_near():
    rng = np.random.default_rng(0)
    p, bad = rng.normal(1, 1, (2000, 3)), rng.normal(-2, 1, (600, 3))
    u = np.concatenate([rng.normal(1, 1, (1400, 3)), bad])
    edges = quality.edges_of(np.concatenate([p, u]))
    prior = quality.estimate_prior(p, rng.permutation(u), edges)
    assert 0.6 < prior < 0.8
    model = quality.descend(p, u, edges, prior)
    assert (model.score(rng.normal(1, 1, (1000, 3))) >= 0.5).mean() > 0.93
    assert (model.score(rng.normal(-2, 1, (1000, 3))) < 0.5).mean() > 0.93


def test_statistics_of_copies_are_equal_whatever_was_seen_before():
    a, b = quality.Tokens(), quality.Tokens()
    text = "Some words. And some WORDS!!\nAnd some words\n".encode()
    quality.statistics(b"other things first", b)
    assert (quality.statistics(text, a) == quality.statistics(text, b)).all()


def test_statistics_equal_plain_counts():
    texts = ["", "One two, TWO!! 33 x\n-- supercalifragilistic end.\nOne two, TWO!! 33 x", " ".join(f"w{i % 7}" for i in range(90)) + "\n\nMore ABC ?? more.", "a"]
    for text in texts:
        tokens, got = text.split(), dict(zip(quality.FEATURES, quality.statistics(text.encode(), quality.Tokens()), strict=True))
        if not tokens:
            assert not any(got.values())
            continue
        letters = [sum(c.isalpha() for c in t) for t in tokens]
        traits = {
            "upper": [n > 1 and t.upper() == t for t, n in zip(tokens, letters, strict=True)],
            "mark_only": [not any(c.isalnum() for c in t) for t in tokens],
            "digits": [any(c.isdigit() for c in t) for t in tokens],
            "long": [n > 13 for n in letters],
            "stop": [t[-1] in ".?" for t in tokens],
            "capital": [t[0].isupper() for t in tokens],
            "repeat": [i > 0 and tokens[i - 1] == t for i, t in enumerate(tokens)],
            "near_repeat": [t in tokens[max(0, i - 3) : i] for i, t in enumerate(tokens)],
        }
        span = min(quality.SPAN, len(tokens))
        for name, marks in traits.items():
            local = [sum(marks[i : i + span]) / span for i in range(len(tokens) - span + 1)]
            assert abs(got[f"{name}_mean"] - np.mean(marks)) < 1e-9 and abs(got[f"{name}_most"] - max(local)) < 1e-9 and abs(got[f"{name}_least"] - min(local)) < 1e-9
        lines = [x for x in text.split("\n") if x.strip()]
        assert abs(got["variety"] - len(set(tokens)) / len(tokens)) < 1e-9 and abs(got["top_share"] - max(map(tokens.count, tokens)) / len(tokens)) < 1e-9
        assert abs(got["line_repeat"] - (1 - len(set(lines)) / len(lines))) < 1e-9 and abs(got["letters_per_word"] - np.mean(letters)) < 1e-9


def test_descent_lowers_the_non_negative_risk():
    rng = np.random.default_rng(0)
    positive = rng.normal(1, 1, (600, 3))
    unlabelled = np.concatenate([rng.normal(1, 1, (500, 3)), rng.normal(-1, 1, (500, 3))])
    edges = quality.edges_of(np.concatenate([positive, unlabelled]))

    def risk(model, prior=0.5):
        g = lambda x: np.log(model.score(x) / (1 - model.score(x)))
        loss = lambda v: np.mean([math.log1p(math.exp(-z)) for z in v])
        return prior * loss(g(positive)) + max(0.0, loss(-g(unlabelled)) - prior * loss(-g(positive)))

    start, end = quality.descend(positive, unlabelled, edges, 0.5, steps=1, rate=1e-9), quality.descend(positive, unlabelled, edges, 0.5)
    assert risk(end) < 0.6 * risk(start)
    truth = np.r_[np.ones(500), np.zeros(500)]
    assert np.mean((end.score(unlabelled) >= 0.5) == truth) > 0.9
