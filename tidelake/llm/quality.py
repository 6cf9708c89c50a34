"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are labelled rows of quality 1; all other text is unlabelled web text. A linear model over
features of the whole text minimises the non-negative risk estimate
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` with the logistic loss; where the bracket
turns negative, steps go the other way, which keeps the model from fitting the unlabelled sample. The class prior is
estimated from the same two samples: the smallest ratio of the shares of unlabelled and positive texts above any
threshold of a first, plain classifier between the two.

The fit uses bounded samples (``max_positive`` and ``max_unlabelled`` rows, those with the smallest hashes of their
ids); scoring covers every whole text in the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import map_texts

#: Classes of bytes whose neighbours are counted: fixed values.
_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t",
    b"\r\n",
    b".",
    b",",
    b"!",
    b"?;:",
    b"'\"()[]{}<>",
    b"-_/\\|",
    b"#$%&*+=^~`@",
    bytes(range(128, 256)),
]
_OF = np.zeros(256, np.intp)
for _k, _members in enumerate(_CLASSES, 1):
    _OF[list(_members)] = _k
N_CLASSES = len(_CLASSES) + 1
N_FEATURES = N_CLASSES * N_CLASSES + 10


def features(text: bytes) -> np.ndarray:
    """Shares of neighbouring byte classes in the whole text, and measures of repetition and word shape."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        out[-1] = 1
        return out
    kinds = _OF[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=N_CLASSES * N_CLASSES)
    out[: N_CLASSES * N_CLASSES] = np.sqrt(pairs / max(1, len(text) - 1))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    out[-8] = len(set(words)) / n
    out[-7] = len(set(lines)) / len(lines)
    out[-6] = min(1.0, len(text) / n / 20)
    out[-5] = np.log1p(n) / 12
    out[-4] = sum(w.isupper() for w in words) / n
    out[-3] = 1 - (sum(map(len, set(lines))) + 1) / (sum(map(len, lines)) + 1)
    out[-2] = len(lines) / n
    out[-9] = sum(map(bytes.__eq__, words, words[1:])) / n
    out[-10] = sum(w.isalpha() or w[:-1].isalpha() or w[-1] >= 128 for w in words) / n
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(x: np.ndarray, gradient, steps: int, rate: float = 0.03) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of tail shares, with a margin for chance."""
    thresholds = np.quantile(positive, np.linspace(0.02, 0.8, 40))
    p = np.array([(positive >= t).mean() for t in thresholds])
    u = np.array([(unlabelled >= t).mean() for t in thresholds])
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    return float(np.clip(((u + margin / 2) / p).min(), 0.05, 0.98))


class PuModel:
    """Linear model on standardised features; ``prior`` is the estimated class prior."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, decay: float = 1e-4):
        both = np.vstack([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 0.02
        p, u = self._ready(positive), self._ready(unlabelled)
        w = np.zeros(p.shape[1], np.float32)

        def plain(w):
            return (p.T @ (_sigmoid(p @ w) - 1)) / len(p) + (u.T @ _sigmoid(u @ w)) / len(u) + 1e-3 * w

        first = _adam(w, plain, steps // 3)
        self.prior = estimated_prior(p @ first, u @ first)

        def risk(w):
            zp, zu = p @ w, u @ w
            up_p = self.prior * (p.T @ (_sigmoid(zp) - 1)) / len(p)
            negative = np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()
            down = (u.T @ _sigmoid(zu)) / len(u) - self.prior * (p.T @ _sigmoid(zp)) / len(p)
            return (up_p + down if negative >= 0 else -down) + decay * w

        self.weights = _adam(w, risk, steps)

    def _ready(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._ready(x) @ self.weights)


def _sampled(docs: DataFrame, ids: DataFrame, limit: int, id_col: str, text_col: str) -> np.ndarray:
    """Features of at most ``limit`` rows of docs whose ids are in ``ids``: those with the smallest hashes."""
    picked = ids.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(limit)  # bounded, so it may be sent
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col, "left_semi")

    def make():
        return lambda ids, texts: {"id": ids, "f": [features(t).tobytes() for t in texts]}

    # an id that rows repeat counts once, by the smallest of its rows, so at most limit rows reach the driver, in fixed order
    kind = docs.schema[id_col].dataType.simpleString()
    got = map_texts(rows, id_col, text_col, make, f"id {kind}, f binary").groupBy("id").agg(F.min("f").alias("f")).orderBy("id").collect()
    return np.array([np.frombuffer(r.f, np.float32) for r in got]).reshape(-1, N_FEATURES)


def fit(
    docs: DataFrame,
    positives: DataFrame,
    unlabelled: DataFrame,
    max_positive: int = 4000,
    max_unlabelled: int = 8000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> PuModel:
    """Fit on the texts of docs whose ids are in the two frames. Without any positives every text scores 0.5."""
    p = _sampled(docs, positives, max_positive, id_col, text_col)
    u = _sampled(docs, unlabelled, max_unlabelled, id_col, text_col)
    none = np.zeros((1, N_FEATURES), np.float32)
    model = PuModel(p if len(p) else none, u if len(u) else none)
    if not len(p) or not len(u):
        model.weights[:] = 0
    return model


def scored(docs: DataFrame, model: PuModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every whole text, null, empty and very long ones included; equal texts have equal scores.

    Rows that repeat an id each have their own row; other columns, whatever their names, are not read.
    """

    def rows():
        return lambda ids, texts: {"id": ids, "score": model.score(np.array([features(t) for t in texts])).tolist()}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, rows, f"id {kind}, score double").withColumnRenamed("id", id_col)


def score_of(model: PuModel, text: Column) -> Column:
    """The score as a column, for filters that keep all other columns without a join."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(bytes(t)) for t in texts])) if len(texts) else [], dtype="float64")

    return score(F.coalesce(text, F.lit("")).cast("binary"))
