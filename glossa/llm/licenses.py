"""License scan with a positional index over rare licence words.

Licence templates are short notices.  Their words are weighted by inverse
document frequency over all scanned documents.  For each file the
``rare_words`` highest-weighted licence words that it holds are looked up in
the template postings; places in the file and in the template are subtracted,
and a template is a candidate at a relative position where several rare words
agree.  The file's other licence words vote only from within a key phrase, so no
template runs out of votes.  A candidate counts only if each mandatory key phrase of the template
stands in the file word by word at that position.

Base labels come from fixed phrases wherever their words stand consecutively.

Defined cases: null and empty texts have no words, no labels and score 0; very
long texts are scanned whole; words of equal weight go by the alphabet; repeated
rows are scanned one by one; a null id is kept; an empty table gives none; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: fixed values: the phrases of the contract and their labels
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: fixed values: label -> (public licence notice in lower-case words, mandatory key phrases within it)
TEMPLATES = {
    "gpl-3.0": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this work is licensed under the gnu general public license version 3",
        ["gnu general public license version 3"],
    ),
    "gpl-3.0-notice": ("under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published by the free software foundation either version 3"]),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    "gpl-2.0-notice": ("under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by the free software foundation either version 2"]),
    "gpl-warranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["without even the implied warranty of merchantability or fitness for a particular purpose"]),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    "agpl-3.0": ("it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license version 2 0"]),
    "apache-2.0-terms": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ["unless required by applicable law or agreed to in writing", "without warranties or conditions of any kind"],
    ),
    "mit-notice": ("this project is released under the mit license", ["under the mit license"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ["permission is hereby granted free of charge", "this software and associated documentation files"],
    ),
    "mit-warranty": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        ["without warranty of any kind express or implied", "in no event shall the authors or copyright holders be liable"],
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ["redistribution and use in source and binary forms", "with or without modification are permitted provided that the following conditions are met"],
    ),
    "bsd-3-clause": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["released into the public domain"]),
    "cc0": ("to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ["to the extent possible under law", "to the public domain worldwide"]),
    "cc-by-4.0": ("this work is licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-sa-4.0": ("this work is licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    "cc-by-nc-4.0": ("this work is licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    "cc-by-nd-4.0": ("this work is licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    "cc-by-4.0-text": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    "all-rights-reserved": ("all rights reserved", ["all rights reserved"]),
}


def words_lower(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def places(words: list[bytes], starts: list[int], phrase: list[bytes]) -> list[int]:
    return [i for i in starts if words[i : i + len(phrase)] == phrase]


class Index:
    def __init__(self, templates: dict, base: dict) -> None:
        self.names = list(templates)
        self.notices = [templates[n][0].encode().split() for n in self.names]
        self.keys = []
        for n, notice in zip(self.names, self.notices, strict=True):
            found = []
            for phrase in (p.encode().split() for p in templates[n][1]):
                at = places(notice, range(len(notice)), phrase)
                if not at:
                    raise ValueError(f"{n}: a key phrase is not in the notice")
                found.append((at[0], phrase))
            self.keys.append(found)
        self.postings = defaultdict(list)
        for t, notice in enumerate(self.notices):
            for i, w in enumerate(notice):
                self.postings[w].append((t, i))
        self.base = [(p.encode().split(), label) for p, label in base.items()]
        self.vocabulary = sorted({*self.postings, *(w for p, _ in self.base for w in p)})
        self.postings = dict(self.postings)
        of_keys = {(t, at + k) for t, keys in enumerate(self.keys) for at, phrase in keys for k in range(len(phrase))}
        self.key_postings = {w: [x for x in found if x in of_keys] for w, found in self.postings.items()}

    def scan(self, text: bytes | None, idf: dict[bytes, float], rare_words: int, vocabulary: frozenset) -> tuple:
        words = words_lower(text)
        where: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in vocabulary:
                where.setdefault(w, []).append(i)
        hits, labels = [], set()
        for phrase, label in self.base:
            if at := places(words, where.get(phrase[0], []), phrase):
                hits += at
                labels.add(label)
        base = sorted(labels)
        rare = sorted((w for w in where if w in self.postings), key=lambda w: (-idf[w], w))
        votes: dict[tuple[int, int], float] = defaultdict(float)
        count: dict[tuple[int, int], int] = defaultdict(int)
        for k, w in enumerate(rare):
            for t, i in (self.postings if k < rare_words else self.key_postings)[w]:
                for p in where[w]:
                    votes[t, p - i] += idf[w]
                    count[t, p - i] += 1
        score = 1.0 if base else 0.0
        for (t, shift), weight in votes.items():
            notice = self.notices[t]
            if count[t, shift] >= min(2, len(notice)) and all(shift + i >= 0 and words[shift + i : shift + i + len(p)] == p for i, p in self.keys[t]):
                labels.add(self.names[t])
                score = max(score, min(1.0, weight / max(sum(idf[w] for w in notice), 1e-9)))
        return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(base), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None, base: dict | None = None, rare_words: int = 16) -> DataFrame:
    """One row per document; see the module's text."""
    index = Index(TEMPLATES if templates is None else templates, BASE_PHRASES if base is None else base)
    vocabulary = frozenset(index.vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = defaultdict(int), 0
        for batch in batches:
            n += batch.num_rows
            for text in texts_of(batch):
                for w in vocabulary.intersection(words_lower(text)):
                    count[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *count], pa.binary()), pa.array([n, *count.values()], pa.int64())], names=["word", "docs"])

    # at most a row for each word of the templates
    seen = {bytes(r.word): r.docs for r in rows.select("text").mapInArrow(frequency, "word binary, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()}
    total = seen.get(b"", 0)
    idf = {w: float(np.log((1 + total) / (1 + seen.get(w, 0))) + 1e-6) for w in index.vocabulary}

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.scan(t, idf, rare_words, vocabulary) for t in texts_of(batch)]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *names])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
