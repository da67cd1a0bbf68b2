import re

import pytest

from glossa.llm import licenses

SCHEMA = "doc_id long, text string"


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "Released under the MIT License.", "mit-license, MIT  license; Apache\nLICENSE", "GNU general public the license",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved", "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY 4.0 and the Apache License, Version 2.0", "cc cc by by cc by", "ÄMIT LICENSE mit licenseé", "apache license version 2", "x " * 80000 + "mit license",
    "version 3 license public general gnu the under licensed", "MIT\x00License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
]


def scanned(spark, rows, **how):
    return licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA), **how).collect()


def test_base_columns_equal_brute_force(spark):
    got = {r.doc_id: r for r in scanned(spark, list(enumerate(TEXTS)))}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1


def test_templates_need_their_key_phrase_in_place(spark):
    got = {r.doc_id: r.labels.split(",") for r in scanned(spark, list(enumerate(TEXTS)))}
    assert "gpl-3.0" in got[5] and "all-rights-reserved" in got[5] and "cc-by-nc-4.0" in got[6]
    assert {"cc-by-4.0", "apache-2.0"} <= set(got[7]) and "mit-text" in got[14]
    assert got[12] == [""] and "apache-2.0" not in got[10]


def test_ties_repeats_and_empty(spark):
    rows = [(1, TEXTS[2]), (1, TEXTS[2]), (None, TEXTS[2])]
    assert len({(r.n_words, r.labels, r.score) for r in scanned(spark, rows)}) == 1 and len(scanned(spark, rows)) == 3
    assert scanned(spark, []) == []


def test_other_columns(spark):
    rows = spark.createDataFrame([(1, "mit license", "w", 2.0)], SCHEMA + ", word string, score double")
    assert licenses.scan_licenses(rows).first().base_labels == "mit"


def test_a_key_phrase_must_be_part_of_its_notice():
    with pytest.raises(ValueError):
        licenses.Index({"x": ("some notice", ["other words"])}, {})


def test_a_notices_file_keeps_templates_of_common_words():
    index = licenses.Index(licenses.TEMPLATES, licenses.BASE_PHRASES)
    common = dict.fromkeys("under the mit license all rights reserved".encode().split(), 0.1)
    idf = {w: common.get(w, 5.0) for w in index.vocabulary}
    text = b"\n".join(b" ".join(notice) for notice in index.notices)
    assert set(licenses.TEMPLATES) <= set(index.scan(text, idf, 16, frozenset(index.vocabulary))[5].split(","))
