"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled as good; everything else is
unlabelled web text of unknown class.  The class prior is estimated as the
least ratio of unlabelled to positive mass above a threshold of a first
classifier (its best upper bin), and a second classifier minimises the
non-negative unbiased risk

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)]).

The classifier is additive over quantile bins of text statistics, so that it
stays monotone-free, cheap and bounded.  Labels, language, source and ids are
never features; the id only picks the fold.  It is fitted on at most about
``sample_rows`` positives and as many unlabelled documents, whole texts.

Defined cases: null and empty texts have the statistics of an empty text and
get a score; a very long text is judged whole, at some tens of bytes a word; a
document with both labels is no positive; a null id is not learnt from; without
positives every score is 0.5; a score of 0.5 is accepted; repeated rows are scored
one by one; an empty table gives none; other columns are ignored or kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, texts_of, tidy, worker_slot

SPAN = 40
SYMBOLS = re.compile(r"[^\w\s]{2,}$|^[^\w\s]+$")
TRAITS = ("upper", "symbols", "mark_only", "digits", "long", "stop", "capital", "repeat", "near_repeat")
FEATURES = [*(f"{t}_{kind}" for t in TRAITS for kind in ("mean", "most", "least")), "log_words", "letters_per_word", "variety", "line_repeat", "log_line_words", "letter_share", "top_share"]


class Tokens(dict):
    """white-space token -> row of its traits; emptied when large."""

    limit, size = 150_000, 1 << 22

    def __init__(self) -> None:
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.fresh: list[tuple] = []
        self.table, self.filled, self.held = np.zeros((1024, 9)), 0, 0

    def __missing__(self, token: bytes) -> int:
        text = token.decode()
        letters = sum(map(str.isalpha, text))
        self.fresh.append((letters > 1 and text.upper() == text, bool(SYMBOLS.search(text)), letters == 0 and not any(map(str.isdigit, text)), any(map(str.isdigit, text)), letters > 13, text[-1] in ".?", text[0].isupper(), letters, len(text)))
        self[token] = self.filled + len(self.fresh) - 1
        self.held += len(token)
        return self[token]

    def traits(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.limit or self.held > self.size:
            self.empty()
        index = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        end = self.filled + len(self.fresh)
        if len(self.table) < end:
            grown = np.zeros((2 * end, 9))
            grown[: self.filled] = self.table[: self.filled]
            self.table = grown
        if self.fresh:
            self.table[self.filled : end] = self.fresh
            self.filled = end
            self.fresh.clear()
        return index, self.table[index]


def statistics(text: bytes | None, cache: Tokens) -> np.ndarray:
    """The FEATURES of a whole text."""
    tokens = text.split() if text else []
    out = np.zeros(len(FEATURES))
    if not tokens:
        return out
    index, rows = cache.traits(tokens)
    n = len(tokens)
    same = np.zeros(n)
    same[1:] = index[1:] == index[:-1]
    near = same.copy()
    for lag in (2, 3):
        near[lag:] = np.maximum(near[lag:], index[lag:] == index[:-lag])
    traits = np.concatenate([rows[:, :7], same[:, None], near[:, None]], axis=1)
    total = np.zeros((n + 1, len(TRAITS)))
    np.cumsum(traits, axis=0, out=total[1:])
    span = min(SPAN, n)
    local = (total[span:] - total[:-span]) / span
    out[: 3 * len(TRAITS)] = np.stack([total[-1] / n, local.max(0), local.min(0)], axis=1).ravel()
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = np.unique(index, return_counts=True)[1]
    out[3 * len(TRAITS) :] = (np.log1p(n), rows[:, 7].mean(), len(counts) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), rows[:, 7].sum() / max(rows[:, 8].sum(), 1), counts.max() / n)
    return out


class Additive:
    """A sum of a weight per feature and quantile bin."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float) -> None:
        self.edges, self.weights, self.bias = edges, weights, bias

    @staticmethod
    def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        width = max(len(e) for e in edges) + 1
        return np.stack([np.searchsorted(e, x[:, j], side="left") + j * width for j, e in enumerate(edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        g = self.weights[self.bins(x, self.edges)].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def edges_of(x: np.ndarray, count: int = 12) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, count + 1)[1:-1])) for j in range(x.shape[1])]


def descend(positive: np.ndarray, unlabelled: np.ndarray, edges: list[np.ndarray], prior: float | None, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> Additive:
    """Adam on the non-negative risk; without a prior, on the plain positive-against-unlabelled log loss."""
    p, u = Additive.bins(positive, edges), Additive.bins(unlabelled, edges)
    size = (max(len(e) for e in edges) + 1) * len(edges)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))

    def back(bins: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = np.zeros(size + 1)
        out[:size] = np.bincount(bins.ravel(), weights=np.repeat(by, bins.shape[1]), minlength=size)
        out[size] = by.sum()
        return out

    for t in range(1, steps + 1):
        gp, gu = w[p].sum(1) + w[size], w[u].sum(1) + w[size]
        sp, su = sigmoid(gp), sigmoid(gu)
        if prior is None:
            grad = back(p, -(1 - sp) / len(p)) + back(u, su / len(u))
        else:
            # log loss: loss(g) = log(1 + exp(-g))
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            rest = back(u, su / len(u)) - prior * back(p, sp / len(p))
            grad = prior * back(p, -(1 - sp) / len(p)) + rest if negative >= 0 else -rest
        grad += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Additive(edges, w[:size], float(w[size]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, edges: list[np.ndarray]) -> float:
    """Least share of unlabelled to positive mass above a threshold, on the half not fitted."""
    first = descend(positive[::2], unlabelled[::2], edges, None, steps=150)
    p, u = np.sort(first.score(positive[1::2])), np.sort(first.score(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    above_p = 1 - np.searchsorted(p, cuts, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, side="left") / len(u)
    # the threshold with the least upper confidence bound, then the plain ratio there
    slack = np.sqrt(np.log(40) / 2)
    bound = (above_u + slack / np.sqrt(len(u))) / np.maximum(above_p - slack / np.sqrt(len(p)), 1e-9)
    at = int(bound.argmin())
    return float(np.clip(above_u[at] / max(above_p[at], 1e-9), 0.05, 0.99))


def features_of(rows: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_slot("traits", Tokens)
        for batch in batches:
            found = [statistics(t, cache).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(found, pa.binary())], names=[*keep, "features"])

    ddl = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep), "features binary"])
    return rows.select(*keep, "text").mapInArrow(tidy(run), ddl)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, held_fold: int, folds: int, sample_rows: int) -> Additive | None:
    learn = F.coalesce(crc_fold("id", folds), F.lit(held_fold)) != held_fold
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(learn)
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(learn & F.col("y").isNotNull()).groupBy("id").agg(F.min("y").alias("y")).where("y = 1").select("id")
    spread = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20))
    part = lambda n: int(min(1.0, sample_rows / max(n, 1)) * (1 << 20)) + 1
    # about sample_rows ids
    chosen = good.where(spread < part(good.count()))
    unlabelled = rows.where(spread >= (1 << 20) - part(rows.count()))

    def gather(found: DataFrame) -> np.ndarray:
        data = features_of(found, []).toArrow()["features"].to_pylist()
        return np.array([np.frombuffer(x) for x in sorted(data)]).reshape(-1, len(FEATURES))

    p, u = gather(rows.join(F.broadcast(chosen), "id", "left_semi")), gather(unlabelled)
    if not len(p) or not len(u):
        return None
    # rows are sorted for a repeatable fit; mix them again
    mix = np.random.default_rng(0)
    p, u = mix.permutation(p), mix.permutation(u)
    edges = edges_of(np.concatenate([p, u]))
    return descend(p, u, edges, estimate_prior(p, u, edges))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_fold: int = 1, folds: int = 3, sample_rows: int = 10_000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, held_fold=held_fold, folds=folds, sample_rows=sample_rows)
    state = model and (model.edges, model.weights, model.bias)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, judge = worker_slot("traits", Tokens), Additive(*state) if state else None
        for batch in batches:
            x = np.array([statistics(t, cache) for t in texts_of(batch)]).reshape(-1, len(FEATURES))
            scores = judge.score(x) if judge else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col), F.coalesce(crc_fold(id_col, folds) == held_fold, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_fold: int = 1, folds: int = 3, sample_rows: int = 10_000) -> DataFrame:
    """``docs``, all columns, without the rows that the classifier rejects."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, held_fold=held_fold, folds=folds, sample_rows=sample_rows)
    if model is None:
        return docs
    state = model.edges, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, judge = worker_slot("traits", Tokens), Additive(*state)
        for batch in batches:
            if batch.num_rows:
                scores = judge.score(np.array([statistics(t, cache) for t in texts_of(batch, text_col)]))
                yield batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
