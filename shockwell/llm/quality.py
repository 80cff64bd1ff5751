"""Quality: Bradley-Terry scores learned from preference pairs of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockwell.llm.batches import append_columns
from shockwell.llm.labelled import MOST_TRAINING_ROWS, training_rows

#: Preference pairs that a fit draws at most.
MOST_PAIRS = 200_000
LETTERS = np.array([chr(c).isalpha() or c >= 128 for c in range(256)])
UPPERS = np.array([65 <= c <= 90 for c in range(256)])
DIGITS = np.array([48 <= c <= 57 for c in range(256)])
SPACES = np.array([c in b" \t\n\r\x0b\x0c" for c in range(256)])
MARKS = np.array([c in b".,;:!?'\"-()" for c in range(256)])


def features(text: str | None) -> list[float]:
    """Shares and logarithms that describe a whole text's form; all 0 for a text without bytes."""
    raw = text.encode() if isinstance(text, str) else b""
    if not raw:
        return [0.0] * N_FEATURES
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words, lines = raw.lower().split(), raw.split(b"\n")
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    letters, spaces, marks, digits = (int(count[m].sum()) for m in (LETTERS, SPACES, MARKS, DIGITS))
    other = n - letters - spaces - marks - digits
    distinct = len(set(words))
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    filled = [x for x in lines if x.strip()]
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in filled)
    m = max(1, len(filled))
    present = count[count > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), letters / n, int(count[UPPERS].sum()) / n, spaces / n, marks / n, digits / n, other / n,
        float(other > 0.02 * n), sizes.mean(), sizes.std(), float((sizes > 14).mean()), float((sizes < 3).mean()), distinct / k,
        distinct / k**0.8, twice / k, pairs / max(1, k - 1), 1 - len(set(filled)) / m, ends / m, np.log1p(k / m), count[ord("|")] / n, float(count[ord("|")] > 2),
        (count[ord("#")] + count[ord("*")] + count[ord("%")] + count[ord("$")] + count[ord("&")]) / n, count[ord(".")] / k, count[ord(",")] / k,
        -float((present * np.log(present)).sum()), count[ord("\n")] / k, (count[ord("{")] + count[ord("<")] + count[ord("=")] + count[ord("/")]) / n,
        float(k < 5), float(twice > 0.2 * k),
    ]


N_FEATURES = 30


@dataclass(frozen=True)
class QualityModel:
    """Utility = weights . basis(features); score = logistic(slope * (utility - cut) + logit(threshold))."""

    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, *(np.maximum(z - k, 0) for k in self.knots)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        u = self.basis(x) @ self.weights
        logit = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.slope * (u - self.cut) + logit, -30, 30)))


def bradley_terry(x: np.ndarray, y: np.ndarray, seed: int = 4, ridge: float = 1e-3, most_pairs: int = MOST_PAIRS) -> np.ndarray:
    """Weights under which P(a preferred to b) = logistic(w . (x_a - x_b)); every pair is a document of label 1 over one of
    label 0, drawn so that each document takes part. Newton steps on the logistic loss of feature differences."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.Generator(np.random.PCG64(seed))
    n = min(most_pairs, max(20 * len(bad), 2 * len(good)))
    d = x[np.resize(draw.permutation(good), n)] - x[np.resize(draw.permutation(bad), n)[draw.permutation(n)]]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / n + ridge * w
        step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) / n + ridge * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "x": [features(t) for t in batch["text"]]})


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, most_rows: int = MOST_TRAINING_ROWS, label: str = "quality") -> QualityModel:
    """Fit on at most `most_rows` labelled rows outside the held-out fold; only their features reach the driver.

    The cut is the quantile of the training utilities at the share of label 0; a text there scores `threshold`. The
    slope is that of a logistic curve through the training labels. Without both labels every text scores `threshold`.
    Of an id with several texts one takes part; rows without id, text or label take none; other columns are ignored.
    """
    rows = training_rows(docs, labels, label, folds, held_out, most_rows).withColumn("id", F.xxhash64("id")).mapInPandas(_features_of, "id long, label int, x array<double>").toPandas().sort_values("id")
    x, y = np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES), rows["label"].to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        one = np.ones(N_FEATURES)
        return QualityModel(0 * one, one, np.zeros(0), 0 * one, 0.0, 1.0, threshold)
    scale = x.std(axis=0)
    knots = np.array([-2.0, -1.0, 0.0, 1.0, 2.0, 3.0])
    base = QualityModel(x.mean(axis=0), np.where(scale > 0, scale, 1.0), knots, np.zeros(0), 0.0, 1.0, threshold)
    b = base.basis(x)
    w = bradley_terry(b, y)
    u = b @ w
    cut = float(np.quantile(u, (y == 0).mean()))
    slope = _slope(u - cut, y)
    return QualityModel(base.mean, base.scale, knots, w, cut, slope, threshold)


def _slope(u: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve P(label 1 | u) with a free intercept, at most 5 per unit."""
    x, w = np.column_stack([u, np.ones(len(u))]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), x.T @ (p - y) + 1e-2 * w)
    return float(np.clip(w[0], 0.05, 5.0))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with quality_score (0 to 1) of each whole text.

    Null and empty texts score like a text whose features are all 0; long ones are read whole. Equal texts get equal scores; an empty table gives
    no rows. A column named quality_score is replaced.
    """

    def make():
        return lambda texts: [model.score(np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES)).tolist()]

    return append_columns(docs, {"quality_score": "double"}, make, [text_col])
