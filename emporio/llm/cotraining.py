"""Operator 5, quality classifier: co-training of a text view and a page-metadata view.

A document is good if it is labelled quality 1 and not toxic.  Two
logistic models see it: one the text (a lexicon of telling words and
word beginnings, and shares of symbols, capitals, repeats, ...), one the page's metadata
(language, source, length).  In each round both score a pool of
unlabelled documents and hand their confident ones, as pseudo-labels, to
the other view.  Each view is calibrated (Platt) on labelled rows that
no fit has seen; the combined score adds the calibrated log odds of both
views and takes off the prior, which both contain.

Fitting uses a bounded sample (``Options``: labelled rows, pool rows),
picked by the hash of doc_id, and reads the whole text of its rows;
scoring covers every document.  Each part of the labelled sample holds
its share of both kinds; a kind of fewer than ``PARTS`` rows is in all
parts.

Defined results: a NULL text is an empty one; NULL metadata are values
of their own; labels repeated for a doc_id count as bad if any is; a
NULL quality is no label, a NULL toxic is not toxic; repeated rows get
one row each; a score on the threshold is kept; without labels of both
kinds every document scores 1; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of

META_SLOTS = 128
#: Of so many labelled rows of a kind the last is held out for calibration.
PARTS = 4
SHARES = 9


@dataclass(frozen=True)
class Options:
    labelled_rows: int = 5000
    pool_rows: int = 2500
    rounds: int = 3
    confident: float = 0.97      # calibrated probability of a pseudo-label
    per_round: int = 500         # pseudo-labels a view hands over in a round, at most
    lexicon: int = 2000          # telling words of the text view, at most
    least_z: float = 4.0         # a telling word's shares differ by so many standard errors
    threshold: float = 0.5


@dataclass
class Logistic:
    """Dense logistic model on standardised columns."""
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25, shift: bool = True) -> Logistic:
    """Newton's method with an L2 penalty."""
    mean = x.mean(axis=0) if shift else np.zeros(x.shape[1])
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0) if shift else np.ones(x.shape[1])
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


BEGINNINGS = (5, 8)


def terms_of(words: list[bytes]) -> set[bytes]:
    """Distinct words and their beginnings, which hold for inflected and joined forms too."""
    s = set(words)
    return s.union(*([w[:k] + b"*" for w in s if len(w) > k] for k in BEGINNINGS))


def shares_of(data: bytes) -> list[float]:
    """Shares that describe the writing, each free of the text's length."""
    n = max(1, len(data))
    tokens = data.split()
    k = max(1, len(tokens))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(1, n - len(data.translate(None, LETTERS)))
    count = lambda chars: n - len(data.translate(None, chars))
    return [math.sqrt(count(b"#*$%&|<>") / k), math.sqrt(count(b"!?") / k), count(UPPER) / letters,
            math.sqrt(count(b"0123456789") / n), sum(map(eq, tokens, tokens[1:])) / k,
            1 - len(set(lines)) / max(1, len(lines)), min(20.0, (n - data.count(b" ")) / k),
            math.sqrt(count(b".,;:") / k), math.log1p(k)]


UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))


def meta_of(lang, source, n_chars) -> list[int]:
    """Slots of a page's metadata: one for each field and value."""
    size = "none" if n_chars is None or pd.isna(n_chars) else str(int(math.log2(max(1, n_chars))))
    return [zlib.crc32(f"{k}={v}".encode()) % META_SLOTS for k, v in (("lang", lang), ("source", source), ("size", size))]


def meta_matrix(slots: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(slots), META_SLOTS))
    for row, s in zip(x, slots):
        row[s] = 1
    return x


def fit_words(sets: list[np.ndarray], y: np.ndarray, size: int, o: Options) -> np.ndarray:
    """Weights by term number: log odds of the terms whose share of documents differs between the classes."""
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    a, b = (np.bincount(np.concatenate([s for s, label in zip(sets, y) if label == k] or [np.zeros(0, int)]),
                        minlength=size) for k in (0, 1))
    p = (a + b + 1) / (n0 + n1 + 2)
    z = np.abs(b / n1 - a / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    best = np.lexsort((np.arange(size), -z))[:o.lexicon]
    best = best[(z[best] >= o.least_z) & ((a + b)[best] >= 5)]
    weights = np.zeros(size)
    weights[best] = np.clip(np.log((b[best] + 0.5) / (n1 + 1)) - np.log((a[best] + 0.5) / (n0 + 1)), -4, 4)
    return weights


def evidence(hits) -> float:
    """The strongest evidence for each side; a sum over all terms would grow with the length of the text."""
    hits = sorted(hits)
    return sum(h for h in hits[:3] if h < 0) + sum(h for h in hits[-3:] if h > 0)


def term_scores(weights: np.ndarray, sets: list[np.ndarray]) -> list[float]:
    return [evidence(w[w != 0].tolist()) for w in (weights[s] for s in sets)]


def fit_text(sets, shares, y, size: int, o: Options) -> tuple[np.ndarray, Logistic]:
    # the lexicon comes from one half and its weight from the other, so that it isn't trusted too much
    weights = fit_words(sets[0::2], y[0::2], size, o)
    x = np.column_stack([term_scores(weights, sets[1::2]), shares[1::2]])
    return weights, fit_logistic(x, y[1::2])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the calibrated log odds."""
    m = fit_logistic(margin[:, None], y, penalty=1e-2, shift=False)
    return max(0.0, float(m.weight[0])), m.bias


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    words: dict[bytes, float] = field(default_factory=dict)  # weights of the telling terms
    text: Logistic | None = None    # over the evidence of the terms and the shares
    meta: Logistic | None = None
    text_line: tuple[float, float] = (1.0, 0.0)
    meta_line: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def odds(self, found, shares, slots) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of both views."""
        t = self.text.margin(np.column_stack([found, shares])) * self.text_line[0] + self.text_line[1]
        m = self.meta.margin(meta_matrix(slots)) * self.meta_line[0] + self.meta_line[1]
        return t, m


@dataclass
class Sample:
    """Rows in the order of their keys; good is NaN where unlabelled."""
    good: np.ndarray
    sets: list[np.ndarray]     # term numbers of each row
    vocabulary: list[bytes]
    shares: np.ndarray
    slots: list[list[int]]

    def take(self, rows) -> tuple[list[np.ndarray], np.ndarray, list[list[int]]]:
        return [self.sets[i] for i in rows], self.shares[rows], [self.slots[i] for i in rows]


def split(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit on and rows held out; every second row to fit on is of one kind as often as the others."""
    train, held = [], []
    for kind in (0.0, 1.0):
        own = np.flatnonzero(good == kind)
        few = len(own) < PARTS
        last = np.arange(len(own)) % PARTS == PARTS - 1
        held.append(own if few else own[last])
        # a pair of rows goes to both halves
        train.append(np.repeat(own, 2) if few else own[~last])
    return np.concatenate(train), np.sort(np.concatenate(held))


def co_train(s: Sample, o: Options) -> Model:
    if len(set(s.good[~np.isnan(s.good)])) < 2:
        return Model()
    train, held = split(s.good)
    pool = np.flatnonzero(np.isnan(s.good))
    (ts, tx, tm), (hs, hx, hm), (ps, px, pm) = s.take(train), s.take(held), s.take(pool)
    ty, hy = s.good[train], s.good[held]
    for_text: dict[int, float] = {}   # pool row -> pseudo-label, by the view that learns from it
    for_meta: dict[int, float] = {}
    model = Model(prior=float(np.log((hy.sum() + 1) / (len(hy) - hy.sum() + 1))))
    for r in range(o.rounds + 1):
        t, m = list(for_text), list(for_meta)
        weights, model.text = fit_text(ts + [ps[i] for i in t], np.vstack([tx, px[t]]),
                                       np.concatenate([ty, [for_text[i] for i in t]]), len(s.vocabulary), o)
        model.meta = fit_logistic(meta_matrix(tm + [pm[i] for i in m]), np.concatenate([ty, [for_meta[i] for i in m]]))
        model.words = {s.vocabulary[i]: float(weights[i]) for i in np.flatnonzero(weights)}
        model.text_line = platt(model.text.margin(np.column_stack([term_scores(weights, hs), hx])), hy)
        model.meta_line = platt(model.meta.margin(meta_matrix(hm)), hy)
        if r == o.rounds or not len(pool):
            break
        given = []
        for odds, learner in zip(model.odds(term_scores(weights, ps), px, pm), (for_meta, for_text)):
            p = sigmoid(odds)
            sure = [i for i in np.argsort(-np.abs(odds), kind="stable").tolist()
                    if max(p[i], 1 - p[i]) >= o.confident and i not in learner][:o.per_round]
            learner.update((i, float(p[i] >= 0.5)) for i in sure)
            given.append(len(sure))
        model.exchanged.append(tuple(given))
        if not any(given):
            break
    return model


def learn(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> Model:
    """Fit on the bounded sample."""
    known = (labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
             .agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")))
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null")
    order = [F.xxhash64("_id"), "_id"]
    # both are limits with a documented bound, on narrow rows
    some = known.join(ids.distinct(), "_id").orderBy(*order).limit(o.labelled_rows)
    more = ids.distinct().join(known, "_id", "left_anti").orderBy(*order).limit(o.pool_rows)
    picked = some.unionByName(more.withColumn("good", F.lit(None).cast("int")))
    rows = (docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("text"),
                        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                        F.col("n_chars").cast("double").alias("n_chars"))
            .join(F.broadcast(picked), "_id"))

    def features(frames):
        for f in frames:
            texts = [bytes(t) if t is not None else b"" for t in f.text]
            yield pd.DataFrame({
                "key": f["_id"], "good": f.good,
                "words": [list(terms_of(words_of(t))) for t in texts],
                "shares": [shares_of(t) for t in texts],
                "slots": [meta_of(*x) for x in zip(f.lang, f.source, f.n_chars)]})

    sample = rows.mapInPandas(features, "key long, good double, words array<binary>, shares array<double>, slots array<int>")
    got = sample.toArrow().combine_chunks()
    key = got.column("key").to_numpy()
    rows = np.unique(key, return_index=True)[1]
    terms = got.column("words").combine_chunks()
    coded = terms.flatten().dictionary_encode()
    codes, ends = coded.indices.to_numpy(), np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy())))
    return co_train(Sample(
        got.column("good").to_numpy()[rows], [codes[ends[i]:ends[i + 1]] for i in rows], coded.dictionary.to_pylist(),
        np.array([got.column("shares")[int(i)].as_py() for i in rows]).reshape(len(rows), SHARES),
        [got.column("slots")[int(i)].as_py() for i in rows]), o)


def scores(docs: DataFrame, model: Model):
    """A column: struct of score, text_score and meta_score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, text_score double, meta_score double")
    def scored(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        m = sent.value
        if m.text is None or not len(text):
            ones = np.ones(len(text))
            return pd.DataFrame({"score": ones, "text_score": ones, "meta_score": ones})
        texts = [bytes(t) if t is not None else b"" for t in text]
        found = [evidence([m.words[w] for w in m.words.keys() & terms_of(words_of(t))]) for t in texts]
        t, k = m.odds(found, np.array([shares_of(x) for x in texts]),
                      [meta_of(*x) for x in zip(lang, source, n_chars)])
        return pd.DataFrame({"score": sigmoid(t + k - m.prior), "text_score": sigmoid(t), "meta_score": sigmoid(k)})

    return scored(F.col("text").cast("binary"), F.col("lang").cast("string"), F.col("source").cast("string"),
                  F.col("n_chars").cast("double"))


def classify(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> DataFrame:
    """One row per document: doc_id, score, text_score, meta_score, keep."""
    model = learn(docs, labels, o)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), scores(docs, model).alias("s"))
            .select("doc_id", "s.*", (F.col("s.score") >= o.threshold).alias("keep")))


def accepted(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> DataFrame:
    """The documents that the classifier keeps, all columns as they were."""
    model = learn(docs, labels, o)
    return docs.where(scores(docs, model)["score"] >= o.threshold)
