"""A quality classifier by positive-unlabelled learning.

Trusted positives are the rows labelled 1; the rest of the text is unlabelled. A linear model over hashed n-grams and a
few densities minimises the non-negative unbiased risk with the sigmoid loss, loss(z) = sigmoid(-z),

    prior * mean_P loss(+z) + max(0, mean_U loss(-z) - prior * mean_P loss(-z)),

and where the second part turns negative, the step goes against it, as the method has it. The loss is bounded, so that
chance in the sample's share of positives doesn't outweigh the rest. The sigmoid of the margin is the score.

The class prior is estimated from positives and unlabelled texts alone (label 0 is never used): a first model tells the
two samples apart on half of the rows; on the other half, the least ratio between the share of unlabelled texts and the
share of positives above a score, where the bound on its chance error is best, is the share of positives among the
unlabelled (best bin estimation). A prior may be given instead.

Nulls: a null text counts as empty, and empty texts get a score; rows with a null doc_id or label aren't learned from.
Very long texts are read whole, in steps that overlap. Repeated rows each get a row and equal texts equal scores; of an
id with several labels the largest counts. Columns that aren't named are ignored. Without trusted positives every score
is the prior, or a half if none is given. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import _features as X
from cadenza.llm._work import TEXTS, drawn, written
from cadenza.llm.language import held_out

#: Trusted positives and unlabelled texts that the model is fitted to: the first of a hash order, never more than these.
POSITIVE_ROWS = 1000
UNLABELLED_ROWS = 2000
PREDICT_FROM = 0.3
#: A hashed n-gram that fewer texts of the sample share has no weight: the model would know texts by heart.
LEAST_TEXTS = 0.02
DENSITIES = 9
MARKS = np.zeros(256, bool)
MARKS[list(b"#*$%&|<>!@[]{}=\\^~_")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def densities(texts: list[bytes]) -> np.ndarray:
    """Log of the word count, shares of distinct words and pairs and of words like the one before, and densities of
    marks, capitals, digits, lines and characters a word."""
    out = np.zeros((len(texts), DENSITIES))
    for k, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        words = text.split()
        n = len(words)
        chars = max(1, len(data))
        out[k] = (
            np.log1p(n),
            len(set(words)) / max(1, n),
            len(set(zip(words, words[1:]))) / max(1, n - 1),  # noqa: B905
            sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1),
            np.count_nonzero(MARKS[data]) / chars,
            np.count_nonzero(UPPER[data]) / chars,
            np.count_nonzero(DIGIT[data]) / chars,
            text.count(b"\n") / max(1, n),
            chars / max(1, n) if n else 0.0,
        )
    return out


@dataclass
class Model:
    weights: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        margin = X.mean_weights(texts, self.weights) + ((densities(texts) - self.mean) / self.scale).clip(-6, 6) @ self.dense + self.bias
        return X.sigmoid(margin)


def vectors(batches):
    for batch in batches:
        texts = X.encoded(batch.column("text"))
        ids, shares = X.sparse(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), *(pa.array([x.tobytes() for x in col], pa.binary()) for col in (ids, shares, densities(texts)))], ["y", "ids", "shares", "dense"]
        )


def sampled(docs: DataFrame, marked: DataFrame, label: int, positive_rows: int, unlabelled_rows: int) -> DataFrame:
    """(text, y): y is 1 for trusted positives and 0 for unlabelled text."""
    known = marked.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("q")).where(F.col("q") == label)
    texts = docs.where(~held_out()).select("doc_id", "text")
    below = lambda seed, share: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20))
    positive = known.where(below(1, 2 * positive_rows / max(1, known.count()))).select("doc_id")  # about 2 * positive_rows ids
    trusted = drawn(texts.join(F.broadcast(positive), "doc_id", "left_semi"), positive_rows, "doc_id", "text")
    rest = drawn(texts.where(below(2, 2 * unlabelled_rows / max(1, texts.count()))), unlabelled_rows, "doc_id", "text")
    return trusted.select("text", F.lit(1.0).alias("y")).unionAll(rest.select("text", F.lit(0.0).alias("y")))


@dataclass
class Sample:
    """Rows as sparse shares of the n-grams that enough texts share, renumbered, and dense densities."""

    sparse: X.Rows
    dense: np.ndarray
    size: int

    def of(self, rows: np.ndarray) -> Sample:
        at = [slice(self.sparse.bounds[r], self.sparse.bounds[r + 1]) for r in rows]
        return Sample(X.Rows([self.sparse.ids[a] for a in at], [self.sparse.shares[a] for a in at]), self.dense[rows], self.size)


def descend(rows: Sample, slope_of: Callable[[np.ndarray], np.ndarray], bias: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, weights of the densities and bias, by steps scaled to the slopes seen. ``slope_of`` gives the risk's slope by each margin."""
    weights, extra = np.zeros(rows.size), np.zeros(DENSITIES)
    seen, seen_extra, seen_bias = np.full(rows.size, 1e-10), np.full(DENSITIES, 1e-10), 1e-10
    for _ in range(epochs):
        slope = slope_of(rows.sparse.times(weights) + rows.dense @ extra + bias)
        back, back_extra, back_bias = rows.sparse.back(slope, rows.size) + 1e-7 * weights, rows.dense.T @ slope + 1e-3 * extra, slope.sum()
        seen, seen_extra, seen_bias = seen + back**2, seen_extra + back_extra**2, seen_bias + back_bias**2
        weights -= 0.5 * back / np.sqrt(seen)
        extra -= 0.3 * back_extra / np.sqrt(seen_extra)
        bias -= 0.2 * back_bias / np.sqrt(seen_bias)
    return weights, extra, bias


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, *, chance: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores that the fit didn't see."""
    at = np.sort(positive)  # every threshold that a positive reaches
    p = 1 - np.arange(len(at)) / len(at)
    u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    slack = np.sqrt(np.log(4 / chance) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((u + slack) / p))
    return float(u[best] / p[best])


def estimated_prior(rows: Sample, y: np.ndarray, epochs: int) -> float:
    """The prior, from two halves in turn: one is fitted to tell positives from unlabelled texts, the other is measured."""
    found = []
    half = np.arange(len(y)) % 2 == 0
    for fit_on in (half, ~half):
        part, t = rows.of(np.flatnonzero(fit_on)), y[fit_on]
        cost = np.where(t > 0, 0.5 / max(1, (t > 0).sum()), 0.5 / max(1, (t == 0).sum()))
        weights, extra, bias = descend(part, lambda z, t=t, cost=cost: (X.sigmoid(z) - t) * cost, 0.0, epochs)
        rest, other = rows.of(np.flatnonzero(~fit_on)), y[~fit_on]
        z = rest.sparse.times(weights) + rest.dense @ extra + bias
        if 0 < other.sum() < len(other):
            found.append(best_bin(z[other > 0], z[other == 0]))
    return float(np.mean(found)) if found else 0.5


def fit(docs: DataFrame, labels: DataFrame, *, prior: float | None = None, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, epochs: int = 300) -> Model:
    got = X.gathered(sampled(docs, labels, 1, positive_rows, unlabelled_rows).mapInArrow(vectors, "y double, ids binary, shares binary, dense binary").toArrow())
    y = np.array([x[0] for x in got])
    size = len(X.FAMILIES) * X.SIZE
    if not 0 < y.sum() < len(y):
        none = 0.5 if prior is None else min(max(prior, 0.01), 0.99)
        return Model(np.zeros((len(X.FAMILIES), X.SIZE), np.float32), np.zeros(DENSITIES), np.zeros(DENSITIES), np.ones(DENSITIES), np.log(none / (1 - none)), none)
    shared = np.bincount(np.concatenate([x[1] for x in got]), minlength=size) >= max(3, LEAST_TEXTS * len(got))
    number = np.cumsum(shared) - 1
    sparse = X.Rows([number[x[1][shared[x[1]]]].astype(np.int32) for x in got], [x[2][shared[x[1]]] for x in got])
    dense = np.stack([np.frombuffer(x[3]) for x in got])
    del got
    mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    rows = Sample(sparse, ((dense - mean) / scale).clip(-6, 6), int(shared.sum()))
    if prior is None:
        prior = estimated_prior(rows, y, epochs // 3)
    prior = min(max(prior, 0.01), 0.99)
    pos, unl = y > 0, y == 0
    negative = np.where(unl, 1 / unl.sum(), -prior / pos.sum())  # weights of loss(-z) in the second part

    def slope_of(z: np.ndarray) -> np.ndarray:
        p = X.sigmoid(z)
        steep = p * (1 - p)
        if float(negative @ p) >= 0:
            return (negative - np.where(pos, prior / pos.sum(), 0)) * steep
        return -negative * steep

    found, extra, bias = descend(rows, slope_of, np.log(prior / (1 - prior)), epochs)
    weights = np.zeros(size, np.float32)
    weights[shared] = found
    return Model(weights.reshape(len(X.FAMILIES), X.SIZE), extra, mean, scale, float(bias), prior)


def score(docs: DataFrame, model: Model, *, predict_from: float = PREDICT_FROM) -> DataFrame:
    """A written table of (doc_id, held_out, score, predicted) of each row, in Arrow batches; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights tables of a fixed size

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([x.encode() if isinstance(x, str) else b"" for x in text]))

    got = written(docs.select("doc_id", held_out().alias("held_out"), scored(F.col("text")).alias("score")), "scores", batches=TEXTS)
    return got.withColumn("predicted", (F.col("score") >= predict_from).cast("int"))
