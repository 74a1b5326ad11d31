"""Quality classifier learned from positive and unlabelled texts.

Trusted positives are texts labelled 1; every other text counts as unlabelled
(a mix of good and bad).  The share of positives in that mix (class prior) is
estimated from the scores of a first classifier on texts that it did not see.
The final classifier minimises the non-negative unbiased risk
``prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))`` with the logistic loss.
Labels 0 are never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Expected number of positive and of unlabelled texts the model is fitted on.
POSITIVES = 8_000
UNLABELLED = 16_000
HIDDEN = 24
EPOCHS = 60
BATCH = 512
RATE = 0.01
DECAY = 1e-4
SEED = 7
_SAMPLE_STEPS = 1_000_000_007
_MARKS = b".,!?|:;-\"'#$%&*@/\\<>()[]{}=+_~^`"


def features(text: str | None) -> np.ndarray:
    """Statistics of one whole text; all zeros for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts = raw.split()
    if not parts:
        return np.zeros(N_FEATURES)
    n, lines = len(raw), [x for x in raw.split(b"\n") if x.strip()]
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = seen / n
    marks = share[list(_MARKS)]
    upper, lower, high = share[65:91].sum(), share[97:123].sum(), share[128:].sum()
    sizes = np.fromiter(map(len, parts), dtype=np.float64, count=len(parts))
    used = share[share > 0]
    m = len(parts)
    return np.concatenate([[
        np.log1p(m), np.log1p(len(lines)), np.log1p(n / len(lines)),
        sizes.mean(), sizes.std(), np.log1p(sizes.max()), (sizes <= 3).mean(),
        upper, lower, high, upper / (upper + lower + 1e-9), share[48:58].sum(),
        marks.sum(), marks[4:].sum(), marks.max(),
        len(set(parts)) / m, len(set(zip(parts, parts[1:]))) / max(1, m - 1), len(set(lines)) / len(lines),
        -(used * np.log2(used)).sum(), len(zlib.compress(raw, 1)) / n,
    ], np.sqrt(marks[:8])])


N_FEATURES = 28


@dataclass(frozen=True)
class Model:
    """Standardisation and one hidden layer; ``prior`` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.layers, np.clip((x - self.mean) / self.scale, -5, 5))[1]

    def score(self, texts) -> np.ndarray:
        rows = [features(t) for t in texts]
        if not rows:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logit(np.array(rows)), -30, 30)))


def _forward(layers: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    h = np.tanh(x @ w1 + b1)
    return h, h @ w2 + b2[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(xp: np.ndarray, xu: np.ndarray, prior: float | None, seed: int) -> tuple:
    """Adam on the non-negative risk; ``prior`` None trains positives against unlabelled plainly."""
    rng = np.random.default_rng(seed)
    d = xp.shape[1]
    layers = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    moment, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    rounds = max(1, len(xu) // BATCH)
    for _ in range(EPOCHS):
        order_p, order_u = rng.permutation(len(xp)), rng.permutation(len(xu))
        for p, u in zip(np.array_split(np.resize(order_p, max(len(xp), rounds)), rounds), np.array_split(order_u, rounds)):
            x = np.concatenate([xp[p], xu[u]])
            h, z = _forward(layers, x)
            zp, zu = z[:len(p)], z[len(p):]
            up, uu = np.full(len(p), 1 / len(p)), np.full(len(u), 1 / len(u))
            if prior is None:
                g = np.concatenate([(_sigmoid(zp) - 1) * up, _sigmoid(zu) * uu])
            else:
                negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                g_neg = np.concatenate([-prior * _sigmoid(zp) * up, _sigmoid(zu) * uu])
                g_pos = np.concatenate([prior * (_sigmoid(zp) - 1) * up, 0 * zu])
                g = g_pos + g_neg if negative >= 0 else -g_neg
            gh = np.outer(g, layers[2]) * (1 - h * h)
            grads = [x.T @ gh + DECAY * layers[0], gh.sum(0), h.T @ g + DECAY * layers[2], np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                moment[k] = 0.9 * moment[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                layers[k] -= RATE * (moment[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return tuple(layers)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, slack: float = 0.1) -> float:
    """Upper estimate of the share of positives among ``unlabelled`` from scores of unseen texts.

    For every threshold, the unlabelled share above it divided by the
    positive share above it bounds the prior; the smallest bound, each with a
    term for its sampling error, is taken.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    above = lambda v: 1 - np.searchsorted(np.sort(v), cuts, side="left") / len(v)
    qp, qu = above(positive), above(unlabelled)
    error = np.sqrt(np.log(4 / slack) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    ok = qp > 0
    best = np.argmin((qu[ok] + error) / qp[ok])
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.01, 0.99))


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    """Model from feature rows; None without positives or without unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        return None
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = (np.clip((x - mean) / scale, -5, 5) for x in (positive, unlabelled))
    if min(len(xp), len(xu)) >= 20:
        first = _train(xp[::2], xu[::2], None, SEED)
        prior = class_prior(_forward(first, xp[1::2])[1], _forward(first, xu[1::2])[1])
    else:
        prior = 0.5
    return Model(mean, scale, _train(xp, xu, prior, SEED + 1), prior)


def _share(keys: Column, expected: int, total: int) -> Column:
    """A fixed share of the keys: about ``expected`` of ``total``, all if there are no more."""
    rate = min(1.0, expected / max(1, total))
    return F.pmod(F.xxhash64(keys), F.lit(_SAMPLE_STEPS)) < F.lit(int(rate * _SAMPLE_STEPS) + 1)


def fit(docs: DataFrame, labels: DataFrame, train: Column,
        positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Fit on about ``positives`` trusted and ``unlabelled`` other texts of the rows where ``train`` holds.

    ``train`` is a condition on ``doc_id``.  The sample is a fixed hash share
    of the rows, so it is the same at every run; only its feature rows come
    to the driver.
    """
    trusted = labels.where((F.col("quality") == 1) & train).select("doc_id").distinct()
    n_docs, n_trusted = docs.where(train).count(), trusted.count()
    # At most about ``positives`` rows: safe to broadcast.
    chosen = trusted.where(_share(F.col("doc_id"), positives, n_trusted)).withColumn("positive", F.lit(True))
    mixed = _share(F.concat(F.lit("u"), F.col("doc_id").cast("string")), unlabelled, n_docs)
    rows = (docs.where(train).select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left")
            .withColumn("mixed", mixed).where("mixed or positive"))

    @F.pandas_udf("array<double>")
    def featured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tolist() for t in texts])

    found = (rows.select("doc_id", "positive", "mixed", featured("text").alias("x"))
             .toPandas().sort_values("doc_id", kind="stable"))
    matrix = lambda keep: np.array(found["x"][keep].tolist()).reshape(-1, N_FEATURES)
    return fit_rows(matrix(found["positive"].eq(True)), matrix(found["mixed"].eq(True)))


def score(model: Model | None, text: Column) -> Column:
    """Score between 0 and 1 of each whole text; 0.5 for every text when nothing could be learned."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return scored(text)


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts are scored like any other (all statistics zero).
    Repeated rows each give a row; a null doc_id is scored, but never taken
    for learning.  Without positives or without training texts every score
    is 0.5.  Other columns are ignored.
    """
    model = fit(docs, labels, train)
    return (docs.select("doc_id", held_out.alias("held_out"), score(model, F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def fold(doc_id: Column) -> Column:
    """Remainder 0, 1 or 2 of the CRC-32 of the id's text; 1 is held out."""
    return F.crc32(doc_id.cast("string")) % 3
