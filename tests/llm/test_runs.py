"""Periodic runs against brute force over all stretches of words."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glossa.llm import queries, runs


def brute_runs(words):
    """Every maximal stretch by its smallest period, by the definition."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), start, length, period, best and 1000 * length // period, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_random_words(letters):
    rng = random.Random(letters)
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += [" ".join((rng.choices(letters, k=rng.randrange(1, 9)) * 9)[: rng.randrange(70)]) for _ in range(60)]
    got = list(runs.batch_runs([t.encode() for t in texts], 6))
    for text, (found, _) in zip(texts, got, strict=True):
        assert [tuple(r) for r in found.tolist()] == brute_runs(text.split())


def test_small_steps_and_groups_give_the_same(monkeypatch):
    texts = [b"x y " * 9, b"a " * 40, None, b"p q r s t u v w " * 6]
    whole = [(r.tolist(), t) for r, t in runs.batch_runs(texts, 6)]
    monkeypatch.setattr(runs, "GRID", 3)
    monkeypatch.setattr(runs, "GROUP_WORDS", 10)
    assert [(r.tolist(), t) for r, t in runs.batch_runs(texts, 6)] == whole
    assert whole == [([[0, 18, 2]], b"x y"), ([[0, 40, 1]], b"a"), ([], b""), ([[0, 48, 8]], b"p q r s t u v w")]


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a a a a a a a"), (None, "a a a a a a a"), (3, "\x85b   c\tc\nc c\x0bc c"), (4, "é " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("ID", F.lit(2))
    got = {(r.doc_id, r.collapsed, tuple(map(tuple, r.runs))) for r in runs.find_runs(docs).collect()}
    assert got == {(1, "", ()), (2, "", ()), (None, "a", ((0, 7, 1),)), (3, "\x85b   c", ((2, 6, 1),)), (4, "é", ((0, 3000, 1),))}
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = {brute_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_periodic_runs(spark, sf)
    assert {tuple(r) for r in got.collect()} == want
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
