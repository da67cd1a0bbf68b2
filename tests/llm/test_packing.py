import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glossa.llm import packing

SCHEMA = "doc_id long, text string"
PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def check(spark, rows):
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas()
    by_doc = {}
    for i, text in rows:
        by_doc.setdefault(i, []).append(ids_of(text))
    pieces = {}
    for r in got.itertuples():
        pieces.setdefault(None if r.doc_id != r.doc_id else r.doc_id, []).append(r)
    assert {k for k in pieces} == set(by_doc)
    for i, texts in by_doc.items():
        want = sorted((s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for ids in texts for s in range(0, len(ids), 4096))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[i]) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 4096
    return got


TEXTS = ["It's the cat's \"hat\", don't... 12.5%!! |x| --- C++", "Ünïcode Straße İstanbul ΣΑΣ οδος é é 日本語 ½ ²", "<|endoftext|> x<|startoftext|>", "<|ENDOFTEXT|> X y<|StartOfText|> <|endoftext|>Z", "a b\x85c d \x1f e", "word,word;word!? ####%%% 'tis 'S 'lls", "", None, "𝔘𝔫𝔦 😀😀 tab\there\n\nnew", "A" * 3000, "don't,'s.", "a\x0bb\x0cc\rd"]


def test_word_ids_equal_the_tokenizers_ids():
    for limit in (250_000, 3):
        cache = packing.TokenCache(PATH)
        cache.limit = limit
        cache.piece = 20
        for text, ids in zip(TEXTS, cache.encode([t and t.encode() for t in TEXTS]), strict=True):
            assert ids + b"\x02\0\0\0" == ids_of(text).tobytes(), text


def test_pieces_of_odd_texts(spark):
    check(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, "no id"), (99, "long words here " * 9000)])


def test_little_padding(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), "word " * int(n)) for i, n in enumerate(np.r_[rng.lognormal(5.5, 1.0, 1500).astype(int) + 1, [300] * 700])]
    got = check(spark, rows)
    assert got.length.sum() / (4096 * got.sequence_id.nunique()) > 0.98


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_plan_covers_the_demand(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(s): int(rng.integers(1, 4000)) for s in rng.choice(np.arange(1, 65), 20, replace=False)}
    sizes, patterns, times = packing.plan(histogram, 64)
    assert ((patterns * times[:, None]).sum(0) == [histogram[int(s)] for s in sizes]).all()
    assert ((patterns @ sizes) <= 64).all()
    lower = sum(s * n for s, n in histogram.items()) / 64
    half = sum(n for s, n in histogram.items() if s > 32)
    assert times.sum() <= max(lower, half) * 1.12 + len(sizes)


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 15), 4, replace=False))
        values = rng.random(4)
        counts = packing.knapsack(values, sizes, 20)
        best = max(values @ np.array(c) for c in np.ndindex(21, 21, 21, 21) if sizes @ np.array(c) <= 20) if sizes[0] > 4 else None
        assert sizes @ counts <= 20
        if best is not None:
            assert values @ counts == pytest.approx(best)


def test_names_that_clash(spark):
    rows = spark.createDataFrame([(1, "a b", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, id int, size string")
    assert sorted((r.doc_id, r.length) for r in packing.pack_documents(rows).collect()) == [(1, 3), (2, 1)]


def test_marks_after_any_letter_are_the_tokenizers():
    letters = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and not 0xD800 <= ord(c) < 0xE000 and not (0x3400 <= ord(c) < 0xA000 or 0xAC00 <= ord(c) < 0xD7A4 or ord(c) >= 0x20000)]
    words = [f"{c}{mark}" for c in letters for mark in ("!", ".", ",")] + [f"a{c}!" for c in letters] + [f"!{c}" for c in letters]
    cache = packing.TokenCache(PATH)
    got = list(cache.encode([w.encode() for w in words]))
    want = TOKENIZER.encode_batch(words, add_special_tokens=False)
    assert [w for w, g, t in zip(words, got, want, strict=True) if g != np.array(t.ids, dtype="<u4").tobytes()] == []


def test_plain_letters_are_tokenised_by_the_model_alone():
    """One trip to the whole tokenizer for the words that need it, the same ids."""
    letters = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x180)) if chr(c).isalpha()]
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(letters, int(n))) + str(rng.choice(["", ".", "!?", "***"])) for n in rng.integers(1, 9, 4000)] + [f"{a}{b}" for a in letters for b in ("", "a", ",")]
    plain = ["andonanednt", "thenshes.", "inanershat,%%%", "straße", "niñez!", "àéîõüÿ", "the"]
    cache = packing.TokenCache(PATH)
    assert cache.alone
    asked = []
    whole = cache.tokenise
    cache.tokenise = lambda words: (asked.extend(words), whole(words))
    for texts in (plain, words):
        for word, ids in zip(texts, cache.encode([w.encode() for w in texts]), strict=True):
            assert ids + b"\x02\0\0\0" == ids_of(word).tobytes(), word
        if texts is plain:
            assert set(asked) == {b".", b",%%%", b"!"}
