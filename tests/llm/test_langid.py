import random

import numpy as np

from glossa.llm import langid
from glossa.llm.common import crc_fold_py

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["the", "ing", "wh", "ou"], "bb": ["der", "sch", "ü", "keit"], "cc": ["qué", "ción", "ll", "os"]}


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((i, " ".join(word(lang) for _ in range(rng.randrange(1, 30))) + ".", lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, r in got.items() if r.held_out} == {i for i, *_ in rows if crc_fold_py(i, 4) == 2}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.98


def test_held_out_labels_change_nothing(spark):
    rows = corpus(200)
    hidden = [(i, t, None if crc_fold_py(i, 4) == 2 else lang) for i, t, lang in rows]
    a, b = (sorted(map(tuple, langid.identify(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, hidden))
    assert a == b


def test_edges(spark):
    rows = corpus(100) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !? 3½", None), (1003, "zzzz", None), (None, "theing", "aa"), (1004, "the " * 60000, None), (1004, "the", None)]
    got = {}
    for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000][0].score == 0
    assert got[1003][0].lang_pred in SYLLABLES and got[None][0].lang_pred == "aa" and len(got[1004]) == 2
    assert all(0 <= r.score <= 1 for x in got.values() for r in x)


def test_no_labels_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "the words", None)], SCHEMA)
    assert langid.identify(rows).first().lang_pred == "und"
    assert langid.identify(rows.limit(0)).collect() == []


def test_words_first_then_shorter_ngrams():
    model = langid.Model.of([("a", 0, "word", 5), ("b", 0, "other", 5), ("a", 2, "xy", 3), ("b", 1, "x", 3), ("b", 1, "q", 1)])
    assert model.word("word").argmax() == 0 and model.word("other").argmax() == 1
    assert model.word("xy").argmax() == 0  # the bigram, though b knows the letter
    assert model.word("q").argmax() == 1
    assert (model.word("ß") == 0).all()


def test_other_columns(spark):
    rows = spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in corpus(60)], SCHEMA + ", held_out int, kind string")
    assert langid.identify(rows).columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_scores_do_not_depend_on_batches(spark):
    rows, size = corpus(300), "spark.sql.execution.arrow.maxRecordsPerBatch"
    # words that training has not seen are scored by n-grams
    rows += [(1000 + i, t[::-1] + "x", None) for i, t, _ in rows[:40]]
    before, seen = spark.conf.get(size), []
    try:
        for n, parts in ((before, 1), (7, 3)):
            spark.conf.set(size, n)
            seen.append({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(spark.createDataFrame(rows, SCHEMA).coalesce(1).repartition(parts)).collect()})
    finally:
        spark.conf.set(size, before)
    assert seen[0] == seen[1]


def test_ties_go_to_the_language_that_sorts_first(spark):
    ids = [i for i in range(40) if crc_fold_py(i, 4) != 2][:4]
    rows = [(i, "the same words", lang) for i, lang in zip(ids, ("bb", "aa", "bb", "aa"), strict=True)] + [(100, "same", None), (101, "unseen", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100] == got[101] == ("aa", 0.5)


def test_backoff_equals_a_plain_one(spark):
    rng = random.Random(9)
    rows = [(lang, k, "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) if not k else "".join(rng.choice("<abc>") for _ in range(k)), rng.randrange(1, 9)) for lang in ("x", "y") for k in (0, 1, 2, 3, 4) for _ in range(12)]
    rows = list({(lang, k, t): (lang, k, t, n) for lang, k, t, n in rows}.values())
    model = langid.Model.of(rows)

    def log(lang, kind, text):
        names, total = {t for _, k, t, _ in rows if k == kind}, sum(n for a, k, _, n in rows if a == lang and k == kind)
        return np.log(sum(n for a, k, t, n in rows if (a, k, t) == (lang, kind, text)) + 0.5) - np.log(total + 0.5 * len(names))

    for word in ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(60)]:
        for j, lang in enumerate(("x", "y")):
            if any(t == word for _, k, t, _ in rows if k == 0):
                want = log(lang, 0, word)
            else:
                marked, parts = f"<{word}>", []
                for i in range(len(marked)):
                    known = [k for k in (4, 3, 2, 1) if i + k <= len(marked) and any((q, t) == (k, marked[i : i + k]) for _, q, t, _ in rows)]
                    parts += [log(lang, known[0], marked[i : i + known[0]])] if known else []
                want = sum(parts) / max(len(parts), 1)
            assert abs(model.word(word)[j] - want) < 1e-9
