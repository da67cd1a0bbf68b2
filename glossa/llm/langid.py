"""Language identification by word-first backoff.

A word that training has seen scores its log frequency in each language.  An
unseen word is scored by character n-grams of its marked form ``<word>``: at
each place the longest n-gram known, from four characters down to one.  A
document's score is the sum over its words, turned into a probability.

The model is fitted on at most about ``sample_docs`` labelled documents, whole
texts, and holds all their words and n-grams.  An n-gram's count is the number of
distinct words of the sample that hold it, times how often each does, so scores
are the same however the table is split.

Defined cases: a text that is null or empty or has no letter is ``und`` with score
0; a very long text is judged whole; without labelled documents everything is
``und``; ties go to the language that sorts first; a null id is not learnt from;
repeated rows are judged one by one; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_fold, texts_of, worker_slot

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)


def words_in(token: bytes) -> list[str]:
    """Runs of letters, lower-cased; a fraction or a raised digit is none."""
    found = LETTERS.findall(token.decode().lower())
    return found if all(map(str.isalpha, found)) else "".join(c if c.isalpha() else " " for w in found for c in (*w, " ")).split()


def ngrams(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + order] for i in range(max(1, len(marked) - order + 1))]


class Model:
    """languages, and for words (0) and each n-gram order where a string's log frequencies per language stand in ``logs``."""

    def __init__(self, languages: list[str], places: dict[int, dict[str, int]], logs: np.ndarray) -> None:
        self.languages, self.places, self.logs = languages, places, logs

    @classmethod
    def of(cls, rows: list[tuple[str, int, str, int]], smoothing: float = 0.5) -> Model:
        """rows: language, 0 for a word or an n-gram's order, the string, its count."""
        languages = sorted({lang for lang, *_ in rows})
        at = {lang: i for i, lang in enumerate(languages)}
        places: dict[int, dict[str, int]] = {}
        parts, done = [np.zeros((0, len(languages)))], 0
        for kind in (0, *ORDERS):
            own = [(at[lang], text, n) for lang, k, text, n in rows if k == kind]
            names = {text: i for i, text in enumerate(sorted({text for _, text, _ in own}))}
            counts = np.zeros((len(names), len(languages)))
            for lang, text, n in own:
                counts[names[text], lang] += n
            totals = counts.sum(0)
            # a language without any of these is no likelier for it
            floor = np.log(np.where(totals > 0, totals, totals.max(initial=0)) + smoothing * max(len(names), 1))
            places[kind] = {text: done + i for text, i in names.items()}
            parts.append(np.log(counts + smoothing) - floor)
            done += len(names)
        return cls(languages, places, np.concatenate(parts))

    def word(self, word: str) -> np.ndarray:
        known = self.places[0].get(word)
        if known is not None:
            return self.logs[known]
        marked, found = f"<{word}>", []
        for i in range(len(marked)):
            for order in ORDERS:
                place = self.places[order].get(marked[i : i + order]) if i + order <= len(marked) else None
                if place is not None:
                    found.append(place)
                    break
        return self.logs[found].sum(0) / max(len(found), 1)


class Scores(dict):
    """white-space token -> row of a score table: a score per language, then 1 if the token has a letter."""

    limit, size = 300_000, 1 << 25

    def __init__(self, model: Model) -> None:
        self.model = model
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.fresh: list[np.ndarray] = []
        self.lettered: list[bool] = []
        self.held = 0
        self.filled, self.table = 0, np.zeros((4096, len(self.model.languages) + 1), dtype=np.float64)

    def __missing__(self, token: bytes) -> int:
        words = words_in(token)
        self.fresh.append(self.model.word(words[0]) if len(words) == 1 else sum(map(self.model.word, words), np.zeros(len(self.model.languages))))
        self.lettered.append(bool(words))
        self[token] = self.filled + len(self.fresh) - 1
        self.held += len(token)
        return self.filled + len(self.fresh) - 1

    def settle(self) -> None:
        """Move new rows to the table."""
        end = self.filled + len(self.fresh)
        if len(self.table) < end:
            grown = np.zeros((2 * end, self.table.shape[1]))
            grown[: self.filled] = self.table[: self.filled]
            self.table = grown
        if self.fresh:
            self.table[self.filled : end, :-1] = self.fresh
            self.table[self.filled : end, -1] = self.lettered
            self.filled = end
            self.fresh.clear()
            self.lettered.clear()

    def judge(self, text: bytes | None) -> tuple[str, float]:
        if len(self) > self.limit or self.held > self.size:
            self.empty()
        tokens = text.split() if text else []
        index = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        self.settle()
        total = self.table[index].sum(0)
        if not total[-1] or not self.model.languages:
            return "und", 0.0
        total = total[:-1]
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, held_fold: int, folds: int, sample_docs: int) -> Model:
    able = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_fold("id", folds), F.lit(held_fold)) != held_fold))
    total = able.count()
    share = min(1.0, sample_docs / max(total, 1))
    sample = able.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                found.setdefault(lang, Counter()).update(text.split())
            out = []
            for lang, tokens in found.items():
                whole: Counter = Counter()
                for token, n in tokens.items():
                    for w in words_in(token):
                        whole[w] += n
                out += [(lang, w, n) for w, n in whole.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.string(), pa.string(), pa.int64()], strict=True)], names=["lang", "item", "n"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, w in zip(batch.column("lang").to_pylist(), batch.column("item").to_pylist(), strict=True):
                found.update((lang, order, g) for order in ORDERS for g in ngrams(w, order))
            out = [(*key, n) for key, n in found.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "kind", "item", "n"])

    # n-grams count once a distinct word of the whole sample, however it is split in batches
    whole = checkpointed(sample.mapInArrow(count, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")))
    pieces = whole.select("lang", "item").mapInArrow(parts, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    kept = whole.select("lang", F.lit(0).alias("kind"), "item", "n").union(pieces).toArrow()
    return Model.of(sorted(zip(*(kept[c].to_pylist() for c in ("lang", "kind", "item", "n")), strict=True)))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_fold: int = 2, folds: int = 4, sample_docs: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, held_fold=held_fold, folds=folds, sample_docs=sample_docs)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.places, model.logs))  # what the sampled texts hold
    key = uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = worker_slot(f"languages {key}", lambda: Scores(Model(*sent.value)))
        for batch in batches:
            found = [scores.judge(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col), F.coalesce(crc_fold(id_col, folds) == held_fold, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
