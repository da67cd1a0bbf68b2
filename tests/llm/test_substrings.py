import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import common, substrings

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    """Words kept of each row, by comparing every window."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                s = tuple(w[k : k + window])
                least[s] = min(i, least.get(s, i))
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def found(spark, rows, window):
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), window=window).collect()
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed and all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False)) for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").encode().split() and [x.decode() for x in (r.text or "").encode().split()])) for r in got), key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(3, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice("klmnop") + str(rng.randrange(300)) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            words += rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(words)))
    return rows


@pytest.mark.parametrize("window", [1, 3, 13])
def test_equals_brute_force(spark, window):
    rows = corpus(window)
    assert found(spark, rows, window) == brute(rows, window)


def test_small_flushes_and_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", 200)
    rows = corpus(7, 150) + [(1000 + i, "the very same short passage of ten words in all") for i in range(200)]
    assert found(spark, rows, 5) == brute(rows, 5)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, " \n\t")],
        [(1, "a b c d"), (1, "a b c d"), (1, "a b c"), (2, "a b c d")],
        [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (-7, "a b c d")],
        [(1, "so so so so so so"), (2, "so so so so so so so so")],
        [(1, "a b c\x85d e \x1f f"), (2, "a b c\x85d e \x1f f")],
        [(1, "w " * 60000), (2, "w " * 50000)],
    ],
)
def test_edges(spark, rows):
    assert found(spark, rows, 3) == brute(rows, 3)


def test_text_keeps_its_spacing_and_other_columns(spark):
    rows = spark.createDataFrame([(1, "a b c", 9, "x"), (2, "one\n a b c two", 8, "y"), (3, "x  y", 7, "z")], SCHEMA + ", bucket int, kind string")
    got = {r.doc_id: r for r in substrings.remove_repeats(rows, window=3).collect()}
    assert got[2].text == "one\n two" and got[2].bucket == 8 and got[3].text == "x  y" and got[1].kind == "x"


def test_sent_rows_round_trip():
    import numpy as np

    rng = np.random.default_rng(0)
    keys, extra = rng.integers(0, 2**64, 1000, dtype=np.uint64), rng.integers(0, 2**16, 1000).astype(np.uint16)
    names = np.array([(i, t) for i, t in zip([-(2**63), -5, 0, 0, 7, 2**40, 2**63 - 1], range(7), strict=True)], dtype=substrings.NAME)
    who = np.arange(1000) % 7
    for bits in (8, 11, 16):
        rows = list(substrings.send(keys, extra, who, names, bits))
        back = [substrings.receive(b, k, w, bits) for b, _, _, k, w in rows]
        got = sorted(zip(*(np.concatenate([x[c] for x in back]).tolist() for c in range(3)), strict=True))
        assert got == sorted(zip(keys.tolist(), extra.tolist(), names[who].tolist(), strict=True))


def test_equal_first_hashes_are_told_apart():
    import numpy as np

    keys, extra = np.array([5, 3, 5, 5, 3], dtype=np.uint64), np.array([1, 0, 2, 1, 0], dtype=np.uint16)
    order, first = substrings.by_hash(keys, extra)
    assert order.tolist() == [1, 4, 0, 3, 2] and first.tolist() == [True, False, True, False, True]


def test_names_that_clash_and_ids_that_are_text(spark):
    rows = spark.createDataFrame([("1", "a b c d", 5, 6, "x"), ("2", "z a b c", 7, 8, "y")], "doc_id string, text string, id int, part int, __id string")
    got = {r.doc_id: r for r in substrings.remove_repeats(rows, window=3).collect()}
    assert got["2"].text == "z " and (got["2"].id, got["2"].part, got["2"]["__id"]) == (7, 8, "y")


def test_digest_matches_the_kept_words(spark):
    rows = corpus(2, 20)
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=4).select("doc_id", F.btrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).alias("t"))
    assert sorted((r.doc_id, r.t) for r in got.collect()) == sorted((i, t) for i, _, _, t in brute(rows, 4))


def test_different_texts_under_one_id_lose_only_their_own_repeats(spark):
    rows = [(1, "a b c d e"), (2, "x a b c d y"), (2, "p q r s t u v"), (2, "k k a b c"), (3, "p q r s z")]
    for parts in (1, 3):
        got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA).coalesce(1).repartition(parts), window=3).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.text.strip()) for r in got) == brute(rows, 3)


def thue_morse(n):
    """A word of n letters and its mirror image, which sums modulo 2**64 can't tell apart."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [256, 1024, 4096, 1 << 20])
def test_long_patterned_words_differ(spark, n):
    one, other = thue_morse(n)
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*words, one])), (2, " ".join([*words, other])), (3, " ".join([*words, other, "x"]))]
    assert found(spark, rows, 13) == brute(rows, 13)


@pytest.mark.parametrize("lower", [True, False])
def test_word_hashes_are_the_same_in_any_place(monkeypatch, lower):
    rng = random.Random(5)
    words = ["".join(rng.choice("aAbBé") for _ in range(n)) for n in (1, 2, 30, 200, 300, 900)] * 3
    text = "\t".join(words)
    hashes = common.WordHashes(lower=lower, second=True)
    whole = next(hashes.of_column(pa.array([text])))
    single = np.concatenate(list(hashes.of_column(pa.array(words))), axis=1)
    monkeypatch.setattr(common, "PIECE", 256)
    pieces = next(hashes.of_column(pa.array([text])))
    assert (whole == single).all() and (whole == pieces).all()
    assert len(set(whole[0].tolist())) == len(set(whole[1].tolist())) == len({w.encode().lower() if lower else w for w in words})
    assert not set(whole[0].tolist()) & set(whole[1].tolist())
    assert (next(common.WordHashes(lower=lower).of_column(pa.array([text]))) == pieces[0]).all()
