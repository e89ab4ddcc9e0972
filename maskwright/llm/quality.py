"""Quality classifier learnt from trusted positives and unlabelled text.

The risk of a classifier over positives P and unlabelled U with class prior p is

    p * risk(P as positive) + max(0, risk(U as negative) - p * risk(P as negative)):

the unbiased estimate, held at zero where over-fitting would make it negative.  While the
second part is below zero its gradient is taken back.  The prior is estimated too: a
first classifier tells P from U, and on texts it was not fitted on the share of U above a score,
over the share of P above it, bounds the positives in U; the least such bound is the prior.

Features are read off the bytes and words of the whole text alone.  The fit takes a bounded
sample, chosen by hash; every text is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

POSITIVES = 8_000  # bound of the sample of trusted positives
UNLABELLED = 16_000  # bound of the sample of unlabelled texts
FOLDS = 5
THRESHOLD = 0.3
RARE = 1e-4  # added to byte shares before the logarithm


# --- features ---------------------------------------------------------------------------------


def features(text: str | None) -> np.ndarray:
    """Shares of the 256 byte values, and the shape of words and lines.  Null counts as empty."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    k = max(1, len(words))
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = raw.split(b"\n")
    word_shape = np.array([
        np.log1p(len(raw)), np.log1p(k), lengths.sum() / k, lengths.std() if len(words) else 0.0,
        distinct / k, distinct / k**0.75, again / k, np.log1p(len(lines)), len(set(lines)) / len(lines),
        (lengths == 1).sum() / k, (lengths > 12).sum() / k,
        counts[65:91].sum() / n, counts[97:123].sum() / n, counts[48:58].sum() / n, counts[128:].sum() / n,
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / n,
    ])
    return np.concatenate([np.log(counts / n + RARE), word_shape]).astype(np.float32)


N_FEATURES = len(features(""))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES), np.float32)


# --- model --------------------------------------------------------------------------------------


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(size: int, rate: float):
    m, v, t = np.zeros(size), np.zeros(size), 0

    def step(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        nonlocal m, v, t
        t += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        return w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    return step


def _discriminate(p: np.ndarray, u: np.ndarray, rounds: int, decay: float) -> np.ndarray:
    """Weights that tell P from U, both sides weighing the same."""
    w, step = np.zeros(p.shape[1], np.float32), _adam(p.shape[1], 0.02)
    for _ in range(rounds):
        g = ((_sigmoid(p @ w) - 1) @ p / len(p) + _sigmoid(u @ w) @ u / len(u)) / 2 + decay * w
        w = step(w, g).astype(np.float32)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> float:
    """The share of positives in U (standardised features, with a column of ones)."""
    halves = [(p[::2], u[::2], p[1::2], u[1::2]), (p[1::2], u[1::2], p[::2], u[::2])]
    found = []
    for fit_p, fit_u, p_rest, u_rest in halves:
        w = _discriminate(fit_p, fit_u, rounds, decay)
        a, b = np.sort(p_rest @ w)[::-1], np.sort(u_rest @ w)[::-1]
        q_p = np.arange(1, len(a) + 1) / len(a)
        q_u = np.searchsorted(-b, -a, side="right") / len(b)
        # slack of a share of so many draws; without it the thin top would decide
        slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(a)) + 1 / np.sqrt(len(b)))
        bound = (q_u + slack) / q_p
        best = int(bound.argmin())
        found.append(q_u[best] / q_p[best])
    return float(np.clip(np.mean(found), 0.05, 0.99))


def fit(positives: np.ndarray, unlabelled: np.ndarray, rounds: int = 400, decay: float = 3e-4, prior: float | None = None) -> Model:
    """Minimise the non-negative risk with the logistic loss.

    Without positives or without unlabelled rows nothing can be learnt: every score is then the
    prior, 0.5 unless given.
    """
    both = np.concatenate([positives, unlabelled])
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, prior or 0.5)
    mean, scale = both.mean(0), both.std(0) + 1e-3

    def ready(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], 1).astype(np.float32)

    p, u = ready(positives), ready(unlabelled)
    prior = prior if prior is not None else estimate_prior(p, u)
    w, step = np.zeros(p.shape[1], np.float32), _adam(p.shape[1], 0.02)
    for _ in range(rounds):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = _sigmoid(zu) @ u / len(u) - prior * (_sigmoid(zp) @ p) / len(p)
        if negative < 0:
            g = -g_negative
        else:
            g = prior * ((_sigmoid(zp) - 1) @ p) / len(p) + g_negative
        w = step(w, g + decay * w).astype(np.float32)
    return Model(mean, scale, w[:-1].astype(float), float(w[-1]), prior)


# --- jobs -----------------------------------------------------------------------------------------


def fold(key: Column) -> Column:
    """0 for rows that are held out: CRC-32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _sample(ids: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most about ``bound`` ids, chosen by hash, the same ones at every run."""
    n = ids.count()
    share = min(1.0, bound / max(1, n))
    return ids.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on the texts that are not held out.

    Positives are the rows that ``labels`` marks 1, the unlabelled sample is drawn from all
    texts; both samples are bounded (POSITIVES, UNLABELLED).  Rows marked 0 are not used as such.
    """
    kept = F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)
    marked = labels.where(F.col(label) == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where(kept).distinct()
    every = docs.select(F.col(key).cast("long").alias("doc_id")).where(kept)
    chosen = (
        _sample(marked, POSITIVES, 1).withColumn("positive", F.lit(True))
        .unionByName(_sample(every, UNLABELLED, 2).distinct().withColumn("positive", F.lit(False)))
    )
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2).to_pylist())
            flat = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(N_FEATURES * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, "<f4").tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], ["doc_id", "positive", "x"])

    # the samples are bounded, so they can go to every task, and their features to the driver
    rows = (
        texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive")
        # of several texts of an id the one with the least hash, so a repeated id is one row
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    )
    got = rows.mapInArrow(run, "doc_id long, positive boolean, x binary").collect()
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    x = np.frombuffer(b"".join(r[2] for r in got), "<f4").reshape(-1, N_FEATURES).astype(np.float64)
    positive = np.array([r[1] for r in got], bool)
    return fit(x[positive], x[~positive])


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1); the other columns don't pass through the worker."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {name} already")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts.tolist())))

    return docs.withColumn(name, score(F.coalesce(F.col(text), F.lit(""))))


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, null and empty texts included.

    predicted is 1 where the score is at least THRESHOLD.  Rows without an id are scored and
    count as the fold of the empty string.  Repeated rows are kept.
    """
    model = train(docs, labels, key, text)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return scored(narrow, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns."""
    model = train(docs, labels, key, text)
    (name,) = fresh(docs, "_score")
    return scored(docs, model, text, name).where(F.col(name) >= THRESHOLD).drop(name)


def held_out(key: int | None) -> bool:
    """The fold rule for one id, as the queries apply it."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS == 0
