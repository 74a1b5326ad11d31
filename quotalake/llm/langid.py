"""Language of a text from averaged hashed subword embeddings.

A text is its character 2-, 3- and 4-grams inside words (with the word's
borders), hashed into a fixed number of buckets.  Each bucket has a small
embedding; the average over all grams of the whole text goes through a linear
softmax.  Embeddings and softmax are learned together by stochastic gradient
descent in numpy.  Probabilities are calibrated, with a temperature that
depends on the number of grams, on texts kept out of the descent, and a text
whose calibrated probability lies below what nearly all of those reach is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
GRAMS = (2, 3, 4)
WIDTH = 16
# Texts the model is fitted on: about so many of all languages together, at least LEAST of each.
SAMPLE = 4_000
LEAST = 20
EPOCHS = 8
RATE = 0.3
# A calibration text in so many is rejected.
REJECTED_SHARE = 0.005
SEED = 11
UNKNOWN = "und"
# Code points handled at once; longer texts go through in pieces that overlap by a gram.
PIECE = 1 << 18
# Words of the short span that each sampled text adds to the examples.
SPAN = 6
_STEPS = 1_000_000_007


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text with 0 for everything but letters; consecutive pieces share three."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for k in range(0, max(1, len(codes)), PIECE):
        some = codes[max(0, k - max(GRAMS) + 1):k + PIECE]
        # Before the first and after the last character stands a border.
        border = [np.zeros(int(at), np.uint32) for at in (k == 0, k + PIECE >= len(codes))]
        yield np.concatenate([border[0], some * _letters()[some], border[1]]).astype(np.uint64)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all grams of a whole text, piece after piece; a gram lies in one word and may include its borders.

    A gram that crosses pieces is found in the piece that ends it.
    """
    first = True
    for codes in _pieces(text or ""):
        found = []
        for n in GRAMS:
            # Only grams that end in new characters, so that none is counted twice.
            start = 0 if first else max(GRAMS) - n
            c = codes[start:]
            if len(c) < n:
                continue
            m = len(c) - n + 1
            h = np.full(m, n, dtype=np.uint64)
            whole = np.ones(m, dtype=bool)
            for k in range(n):
                part = c[k:m + k]
                h = (h + part) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if 0 < k < n - 1:
                    whole &= part != 0
            if n == 2:
                whole &= (c[:m] != 0) | (c[1:] != 0)
            found.append((h[whole] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        first = False
        yield np.concatenate(found) if found else np.zeros(0, np.int32)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for some in grams(text):
        total += np.bincount(some, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """``table``: each bucket's share of the logits (its embedding times the softmax weights)."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: tuple[float, float]
    reject_below: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for some in grams(text):
            total += self.table[some].sum(0, dtype=np.float64)
            n += len(some)
        return _calibrated(total / max(1, n) + self.bias, n, self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _calibrated(logits: np.ndarray, n, temperature: tuple[float, float]) -> np.ndarray:
    """Softmax at the temperature exp(a - b log(1 + n)) for n grams."""
    a, b = temperature
    return _softmax(logits / np.expand_dims(np.exp(a - b * np.log1p(n)), -1))


def _descend(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(logit table, bias) by gradient descent on one example after another.

    A step is divided by the squared weights of the example's buckets, so
    that long and short texts move their average alike.
    """
    rng = np.random.default_rng(SEED)
    embedding = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, classes)), np.zeros(classes)
    weights[:] = rng.normal(0, WIDTH ** -0.5, weights.shape)
    seen = np.bincount([y for _, _, y in examples], minlength=classes)
    balance = len(examples) / (np.maximum(seen, 1) * max(1, (seen > 0).sum()))
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            at, share, y = examples[i]
            rate = RATE * (1 - done / steps)
            done += 1
            x = share @ embedding[at]
            g = _softmax(x @ weights + bias)
            g[y] -= 1
            g *= min(balance[y], 10.0)
            back = weights @ g
            weights -= rate * np.outer(x, g)
            bias -= rate * 0.1 * g
            embedding[at] -= np.outer(share * (rate / (share @ share)), back)
    return (embedding @ weights).astype(np.float32), bias


def fit_rows(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """Model from rows (lang, buckets, counts); None without rows.

    Every fifth row is kept out of the descent and calibrates the
    probabilities (all rows do where there are fewer than 20).
    """
    rows = [r for r in rows if len(r[1])]
    langs = tuple(sorted({r[0] for r in rows}))
    if not langs:
        return None
    number = {lang: k for k, lang in enumerate(langs)}
    examples = [(np.asarray(at), np.asarray(n) / np.sum(n), number[lang]) for lang, at, n in rows]
    few = len(rows) < 20
    learned = examples if few else [x for k, x in enumerate(examples) if k % 5]
    table, bias = _descend(learned, len(langs))
    kept = range(len(rows)) if few else range(0, len(rows), 5)
    logits = np.array([examples[k][1] @ table[examples[k][0]] + bias for k in kept])
    sizes, truth = np.array([np.sum(rows[k][2]) for k in kept]), np.array([examples[k][2] for k in kept])

    def loss(t: tuple[float, float]) -> float:
        return -np.log(_calibrated(logits, sizes, t)[np.arange(len(truth)), truth] + 1e-12).mean()

    grid = [(a, b) for a in np.linspace(-3, 3, 25) for b in np.linspace(0, 1, 11)]
    temperature = min(grid, key=loss)
    sure = _calibrated(logits, sizes, temperature).max(1)
    return Model(langs, table, bias, temperature, float(np.quantile(sure, REJECTED_SHARE)))


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE) -> Model | None:
    """Fit on about ``sample`` different texts of the rows where ``train`` holds, alike for each language that has enough.

    The sample is a fixed hash share of the texts (equal texts count once),
    each with a span of SPAN words out of it as a second example.  Only its
    bucket counts, at most BUCKETS a text, reach the driver.  Rows with a
    null lang, or a text without a letter, are not learned from.
    """
    # Rows whose condition is not known (a null id) are learned from by nobody.
    known = (docs.where(train).where("lang is not null and text is not null")
             .select("lang", "text", F.xxhash64("text").alias("key")))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").agg(F.approx_count_distinct("key", 0.02)).collect()}
    if not sizes:
        return None
    each = max(LEAST, sample // len(sizes))
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, each / max(1, n)) * _STEPS) + 1)])
    chosen = (known.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(_STEPS)) < rate[F.col("lang")])
              .groupBy("lang", "key").agg(F.first("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = text.split()
                start = key % max(1, len(parts) - SPAN)
                for n, some in enumerate((text, " ".join(parts[start:start + SPAN]))):
                    at, count = _counted(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([key]), pa.array([n], pa.int32()), pa.array([at.astype(np.int32).tolist()], pa.list_(pa.int32())),
                         pa.array([count.tolist()], pa.list_(pa.int64()))], ["lang", "key", "n", "at", "count"])

    found = chosen.mapInArrow(run, "lang string, key long, n int, at array<int>, count array<long>").toPandas()
    found = found.sort_values(["n", "key", "lang"], kind="stable")
    return fit_rows(list(zip(found["lang"], found["at"], found["count"])))


def identify(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs``.

    ``lang_pred`` is the likeliest learned language of the whole text and
    ``score`` its calibrated probability; both are ``und`` and 0 for a text
    that is null or has no letter, or where nothing could be learned.
    ``rejected`` is true for those, and for texts whose score lies below the
    model's threshold.  Repeated rows and null ids each give a row; other
    columns are ignored.
    """
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if model is None or not has_letter(text):
                rows.append((UNKNOWN, 0.0, True))
                continue
            p = model.probabilities(text)
            best = int(p.argmax())
            rows.append((model.langs[best], float(p[best]), bool(p[best] < model.reject_below)))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return (docs.select("doc_id", held_out.alias("held_out"), judged("text").alias("judged"))
            .select("doc_id", "held_out", "judged.*"))


def fold(doc_id: Column) -> Column:
    """Remainder 0 to 3 of the CRC-32 of the id's text; 2 is held out."""
    return F.crc32(doc_id.cast("string")) % 4
