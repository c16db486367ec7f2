"""Toxicity by a classifier chain.

The categories are predicted one after another. Each is a sparse linear (logistic) model over word
features and the probabilities of the categories before it; while training, those probabilities are
out-of-fold predictions, so a later model sees earlier ones as unsure as they are on new text.

Defined cases: a null or empty text has no feature and gets the base rates; text is lower-cased and used
whole; repeated words count up to ``COUNT_CAP``, which is a saturating feature and not a limit on
the text; label rows without a document, with a null label or a null id are not learned from; several
label rows of a document count as their maximum, and of rows of one id one is learned from; ties at
the threshold are flagged. With no label at all every probability is 0.

What a model may learn is bounded by parameters of ``fit``, each of which can be switched off (None, or 0
for the least values): features are chosen on the labelled sample by how well they tell a category.
Equal texts share a fold, so none is predicted by a model that has seen it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlmill.llm.common import bounded_sample, cut, frames, share

#: Bounds of the fit, whatever the size of the corpus: labelled rows and features per category (None: all).
MAX_LABELLED_ROWS, MAX_FEATURES = 12_000, 256
#: Rows that a feature must be met in, its least z score for a category, and the largest count of it that tells more (None: any).
MIN_ROWS, MIN_Z, COUNT_CAP = 4, 5.0, 4
FOLDS = 5
#: Runs of letters, and runs of signs.
WORD = re.compile(r"[^\W\d_]+|[^\w\s]+")


def features_of(word: str) -> list[str]:
    """The word itself and its stems of three to six letters."""
    return [f"={word}", *(word[:n] for n in range(3, min(len(word), 6) + 1))]


@dataclass(frozen=True)
class Chain:
    """A fitted chain: one weight row per category over the features, then over earlier probabilities."""

    categories: tuple[str, ...]
    features: tuple[str, ...]
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    thresholds: tuple[float, ...] = ()
    count_cap: int | None = COUNT_CAP

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        n = len(self.features)
        out = np.zeros((len(counts), len(self.categories)))
        for k in range(len(self.categories)):
            z = counts @ self.weights[k, :n] + out[:, :k] @ self.weights[k, n : n + k] + self.bias[k]
            out[:, k] = 1 / (1 + np.exp(-z))
        return out


class Counts:
    """Text to saturated feature counts, remembering the features of words already met."""

    def __init__(self, features: tuple[str, ...], cap: int | None = COUNT_CAP, keep: int = 150_000):
        self.at = {x: i for i, x in enumerate(features)}
        self.cap, self.keep = cap, keep
        self.seen: dict[str, tuple[int, ...]] = {}

    def row(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(self.at), np.float32)
        if len(self.seen) > self.keep:
            self.seen.clear()
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            hits = self.seen.get(word)
            if hits is None:
                hits = self.seen[word] = tuple(self.at[x] for x in features_of(word) if x in self.at)
            for i in hits:
                out[i] += n
        return out if self.cap is None else np.minimum(out, self.cap)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 250, l1: float = 2e-4) -> tuple[np.ndarray, float]:
    """L1-regularised logistic regression by accelerated proximal gradient."""
    n = max(len(y), 1)
    rate = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
    w, b = np.zeros(x.shape[1], np.float32), np.log(rate / (1 - rate))
    x, y = x.astype(np.float32), y.astype(np.float32)
    if not 0 < y.sum() < len(y):
        return w, float(b)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # largest eigenvalue of the Gram matrix, for the step size
        v = x.T @ (x @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 4 / (np.linalg.norm(x @ v) ** 2 / n + 1)
    wm, bm, t = w, b, 1.0
    for _ in range(steps):
        g = ((1 / (1 + np.exp(-(x @ wm + bm))) - y) / n).astype(np.float32)
        w1 = wm - np.float32(step) * (x.T @ g)
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - np.float32(step * l1), 0)
        b1 = bm - step * g.sum()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wm, bm = w1 + np.float32((t - 1) / t1) * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w.astype(np.float64), float(b)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities, midway between neighbours."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    best = int(np.argmax(f1))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def fold_of(text: str | None) -> int:
    """The fold of a text: equal texts share one."""
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass")) % FOLDS


def fit_matrix(categories: tuple[str, ...], features: tuple[str, ...], x: np.ndarray, labels: np.ndarray, fold: np.ndarray | None = None, count_cap: int | None = COUNT_CAP) -> Chain:
    """Fit the chain on a bounded matrix of counts; fold: of each row, by default its number modulo ``FOLDS``."""
    n, k = len(features), len(categories)
    weights, bias, cuts = np.zeros((k, n + k)), np.zeros(k), []
    fold = np.arange(len(x)) % FOLDS if fold is None else fold
    before = np.zeros((len(x), 0))
    for c in range(k):
        own, y = np.hstack([x, before]), labels[:, c].astype(float)
        out = np.zeros(len(x))
        for f in range(FOLDS):
            w, b = _logistic(own[fold != f], y[fold != f])
            out[fold == f] = 1 / (1 + np.exp(-(own[fold == f] @ w + b)))
        w, bias[c] = _logistic(own, y)
        weights[c, : n + c] = w
        cuts.append(_threshold(out, y))
        before = np.hstack([before, out[:, None]])
    return Chain(categories, features, weights, bias, tuple(cuts), count_cap)


def fit(
    docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], key: str = "doc_id", text: str = "text", max_rows: int = MAX_LABELLED_ROWS,
    max_features: int | None = MAX_FEATURES, min_rows: int = MIN_ROWS, min_z: float = MIN_Z, count_cap: int | None = COUNT_CAP,
) -> Chain:
    """Fit a chain on at most ``max_rows`` labelled documents.

    Executors count in how many labelled documents each feature occurs; the driver gets, of the features
    that tell a category best (z score), at most ``max_features`` per category, and one row of counts per
    sampled document.
    """
    own = labels.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories]).dropna()
    chosen = bounded_sample(own, max_rows)
    # at most max_rows slim rows, so the sample may be broadcast; of documents with equal ids one is taken
    met = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)
    sample = cut(met.groupBy(key, *categories).agg(F.min("text").alias("text")).select("text", *categories))  # so all texts are read once

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, by = Counter(), [Counter() for _ in categories]
        for batch in batches:
            for t, *ys in batch.itertuples(index=False):
                found = {x for w in set(WORD.findall((t or "").lower())) for x in features_of(w)}
                n.update(found)
                for c, y in zip(by, ys):
                    if y:
                        c.update(found)
        yield from frames(((x, k, *[c[x] for c in by]) for x, k in n.items()), ["feature", "n", *[f"n{i}" for i in range(len(by))]])

    schema = "feature string, n long, " + ", ".join(f"n{i} long" for i in range(len(categories)))
    total = sample.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    if not total["n"]:
        return Chain(categories, (), np.zeros((len(categories), len(categories))), np.full(len(categories), -50.0), (1.0,) * len(categories))
    seen = cut(sample.mapInPandas(count, schema).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *(f"n{i}" for i in range(len(categories))))]).where(F.col("n") >= min_rows))
    names: set[str] = set()
    for i, c in enumerate(categories):
        rate = (total[c] or 0) / total["n"]
        if 0 < rate < 1:
            z = (F.col(f"n{i}") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
            best = seen.select("feature", z.alias("z")).where(F.abs("z") >= min_z).orderBy(F.desc(F.abs("z")), "feature")
            names |= {r.feature for r in (best if max_features is None else best.limit(max_features)).collect()}
    features = tuple(sorted(names))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(features, count_cap)
        for batch in batches:
            rows = [counts.row(t) for t in batch["text"]]
            yield pd.DataFrame({"at": [np.flatnonzero(r).tolist() for r in rows], "value": [r[r > 0].tolist() for r in rows], "y": batch[list(categories)].values.tolist(), "fold": [fold_of(t) for t in batch["text"]]})

    got = sample.mapInPandas(sparse, "at array<int>, value array<float>, y array<int>, fold int").collect()  # at most max_rows rows
    got.sort(key=lambda r: (r.at, r.value, r.y, r.fold))  # an order of its own, whatever the partitions
    x = np.zeros((len(got), len(features)), np.float32)
    for i, r in enumerate(got):
        x[i, r.at] = r.value
    return fit_matrix(categories, features, x, np.array([r.y for r in got]), np.array([r.fold for r in got], int), count_cap)


def with_scores(df: DataFrame, chain: Chain, text: str = "text", to: str = "scores") -> DataFrame:
    """``df`` with ``to``, an array of the categories' probabilities; a column of that name is replaced."""
    model = share(df.sparkSession, (chain, Counts(chain.features, chain.count_cap)))  # at most max_features weights per category

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted, counts = model.value
        for batch in batches:
            rows = np.stack([counts.row(t) for t in batch]) if len(batch) else np.zeros((0, len(fitted.features)))
            yield pd.Series(list(fitted.probabilities(rows)))

    return df.withColumn(to, score(F.col(text)))


def flag(chain: Chain, category: str, scores: str = "scores") -> Column:
    """Whether a row of ``with_scores`` is in a category."""
    i = chain.categories.index(category)
    return F.col(scores)[i] >= F.lit(chain.thresholds[i])


def predict(df: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_", flag_prefix: str = "is_") -> DataFrame:
    """``df`` with a probability and a decision per category; columns of those names are replaced."""
    names = [f"{prefix}{c}" for c in chain.categories] + [f"{flag_prefix}{c}" for c in chain.categories]
    kept = [c for c in df.columns if c not in names]
    return with_scores(df, chain, text, "__p").select(
        *kept,
        *[F.col("__p")[i].alias(f"{prefix}{c}") for i, c in enumerate(chain.categories)],
        *[flag(chain, c, "__p").alias(f"{flag_prefix}{c}") for c in chain.categories],
    )
