"""Quality rules: counts with fixed limits, then hashed n-gram logistic regression.

The model sees hashed byte 4-grams, words and word pairs. It is trained on labelled rows, its margin is calibrated to a
probability on rows that the fit didn't see (a logistic curve), and texts are scored in Arrow batches against a fixed
threshold.

Nulls: a null text has no words and so fails the base rules; a null label or doc_id isn't learned from. Empty and blank
texts have no words. Very long texts are read whole, in steps that overlap. Repeated rows are judged alike, each by
itself; of an id with several labels the largest counts. A score equal to the threshold is kept. Results come beside the
caller's row, whose columns may have any names. With no labelled rows, or only one class, the model says nothing and the
base rules decide alone. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import _features as X
from cadenza.llm._work import drawn, text_batches

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
#: Labelled rows that a model is fitted to: the first of a hash order, so never more than these.
TRAIN_ROWS = 3000
SYMBOLS = b"#*$%&|<>"

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if 3 * (n - 2) and len(ids) == n:
        return 0
    pairs = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]  # ranks, so that products stay small
    windows = pairs[:-1] * np.int64(len(ids)) + seq[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    chars = int(np.count_nonzero((data & 0xC0) != 0x80)) - sum(text.count(bytes([s])) for s in X.SPACES)
    symbols = sum(text.count(bytes([s])) for s in SYMBOLS)
    seen: set[bytes] = set()
    dups = 0
    for line in text.split(b"\n"):
        if line in seen:
            dups += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, symbols, dups, repeat_words(words)


@dataclass
class Model:
    """weights: one row a family. The calibrated probability is sigmoid(slope * margin + offset)."""

    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return X.sigmoid(self.slope * X.mean_weights(texts, self.weights) + self.offset)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y): ``rows`` labelled texts at most, chosen by a hash, so that reruns agree."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    share = 2 * rows / max(1, marked.count())
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)))  # about 2 * rows ids
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("y").cast("double"))
    return drawn(found, rows, "doc_id", "text")


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, shares = X.sparse(X.encoded(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in shares], pa.binary())], ["y", "ids", "shares"])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits best, by Newton's method with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = margin.std() or 1.0
    design = np.stack([margin / scale, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = X.sigmoid(design @ theta)
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (p - target) + 1e-3 * theta)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0] / scale), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, epochs: int = 80) -> Model | None:
    got = X.gathered(sample(docs, labels, "quality", rows).mapInArrow(vectors, "y double, ids binary, shares binary").toArrow())
    y, ids, shares = np.array([x[0] for x in got]), [x[1] for x in got], [x[2] for x in got]
    held = np.arange(len(y)) % 4 == 0
    if not all(0 < y[part].sum() < part.sum() for part in (held, ~held)):
        return None
    train = X.Rows([x for x, h in zip(ids, held, strict=True) if not h], [x for x, h in zip(shares, held, strict=True) if not h])
    size = len(X.FAMILIES) * X.SIZE
    weights, bias, seen = np.zeros(size), 0.0, np.full(size, 1e-6)
    t = y[~held]
    cost = np.where(t > 0, 0.5 / t.sum(), 0.5 / (1 - t).sum())  # both classes weigh the same
    for _ in range(epochs):
        error = (X.sigmoid(train.times(weights) + bias) - t) * cost
        slope = train.back(error, size)
        seen += slope**2
        weights -= 4.0 * slope / np.sqrt(seen) * (seen > 1e-6)
        bias -= error.sum()
    rest = X.Rows([x for x, h in zip(ids, held, strict=True) if h], [x for x, h in zip(shares, held, strict=True) if h])
    slope, offset = platt(rest.times(weights), y[held])
    return Model(weights.reshape(len(X.FAMILIES), X.SIZE).astype(np.float32), slope, offset)


def judge(docs: DataFrame, model: Model | None, *, keep_from: float = KEEP_FROM) -> DataFrame:
    """(row, the counts, score, base_failed, kept): the caller's row as a struct, and the verdict, row by row; no shuffle."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weights tables of fixed size

    @F.pandas_udf(T.StructType([T.StructField(x.split()[0], T.LongType()) for x in STATS.split(", ")] + [T.StructField("score", T.DoubleType())]))
    def judged(text: pd.Series) -> pd.DataFrame:
        texts = [x.encode() if isinstance(x, str) else b"" for x in text]
        out = pd.DataFrame(np.array([counts(x) for x in texts], np.int64).reshape(-1, 5), columns=[x.split()[0] for x in STATS.split(", ")])
        out["score"] = shared.value.scores(texts) if shared.value is not None else 1.0
        return out

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    got = docs.select(F.struct("*").alias("row"), judged(F.col("text")).alias("judged")).select("row", "judged.*")
    return got.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= keep_from))
