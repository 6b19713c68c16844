"""Quality scores by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lean, text_bytes

LABELLED = 6000  # labelled rows that the fit may take; bounds the driver's memory
PAIRS = 40_000
THRESHOLD = 0.7

_CLASS = np.zeros((256, 9))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b, 0] = "A" <= _c <= "Z"
    _CLASS[_b, 1] = "a" <= _c <= "z"
    _CLASS[_b, 2] = "0" <= _c <= "9"
    _CLASS[_b, 3] = _c in " \t\r"
    _CLASS[_b, 4] = _c == "\n"
    _CLASS[_b, 5] = _c in ".,;:'\"-"
    _CLASS[_b, 6] = _b < 128 and _b > 32 and not _c.isalnum() and _c not in ".,;:'\"-!?"
    _CLASS[_b, 7] = _c in "!?"
    _CLASS[_b, 8] = _b >= 128

SPAN = 100


def features(text: bytes) -> list[float]:
    """Of the whole text; an empty one has zeros."""
    n = len(text)
    if not n:
        return [0.0] * N_FEATURES
    up, low, digit, space, line, punct, symbol, shout, high = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / n
    w = text.lower().split()
    k = len(w)
    if not k:
        return [0.0] * N_FEATURES
    distinct = [len(set(w[i : i + SPAN])) / min(SPAN, k - i) for i in range(0, k, SPAN) if k - i >= SPAN // 2 or i == 0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = up + low + high
    return [
        math.log1p(k), (n - n * (space + line)) / k / 10, up / max(letters, 1e-9), digit, 10 * punct, 10 * symbol, 10 * shout, letters,
        10 * line, sum(distinct) / len(distinct), min(distinct), sum(map(operator.eq, w, islice(w, 1, None))) / k,
        1 - len(set(lines)) / max(1, len(lines)), min(k, 20) / 20, 1 - len(set(w)) / k, high,
    ]


N_FEATURES = 16


def _expand(x: np.ndarray) -> np.ndarray:
    """Standardised features are clipped, and their squares let a score fall at both ends."""
    x = np.clip(x, -5, 5)
    return np.hstack([x, x * x])


def fit(x: np.ndarray, labels: np.ndarray, seed: int = 10) -> dict:
    """Bradley-Terry: P(a above b) = sigmoid(w.(f(a) - f(b))) over preference pairs, by gradient descent.

    The threshold is the quantile of the scores below which the share of label 0 lies; a score there maps to 0.7.
    Without rows of both labels all scores are 0.7.
    """
    x, y = np.asarray(x, dtype=float).reshape(-1, N_FEATURES), np.asarray(labels)
    if not len(y) or y.min() == y.max():
        return {"mean": np.zeros(N_FEATURES), "std": np.ones(N_FEATURES), "w": np.zeros(2 * N_FEATURES), "cut": 0.0, "scale": 1.0}
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = _expand((x - mean) / std)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w, m, v = np.zeros(d.shape[1]), 0.0, 0.0
    for t in range(1, 401):
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    s = z @ w
    # the quantile, between its two neighbours: the middle of the gap
    o = np.sort(s)
    k = len(bad)
    cut = (o[k - 1] + o[min(k, len(o) - 1)]) / 2
    return {"mean": mean, "std": std, "w": w, "cut": float(cut), "scale": float(4 / (np.std(s) + 1e-9))}


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    x = np.array([features(t) for t in texts], dtype=float).reshape(-1, N_FEATURES)
    s = _expand((x - model["mean"]) / model["std"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(model["scale"] * (s - model["cut"]) + math.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", labelled: int = LABELLED) -> dict:
    """Learns from at most `labelled` pairs of a labelled document and its label outside the held-out fold, those with
    the least hash of their id.

    Rows with null id, text or label give nothing, and labels without a document don't count. A key with several
    labels gives each of them once; of several texts that share a key the one with the least hash counts.
    """
    kept = labels.select(key, "quality").where(F.col("quality").isin(0, 1) & F.col(key).isNotNull() & ~fold(key, 4, 2)).distinct()
    there = documents.where(F.col("text").isNotNull()).select(key)
    kept = kept.join(there, key, "left_semi").orderBy(F.xxhash64(key), key, "quality").limit(labelled)
    rows = documents.select(key, F.col("text")).where(F.col("text").isNotNull()).join(F.broadcast(kept), key).select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), "quality", text_bytes().alias("t"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("k"), b.column("quality").cast(pa.int32()), b.column("th"), pa.array(found, pa.list_(pa.float64()))], names=["h", "k", "quality", "th", "x"])

    # features, not texts, come to the driver
    kind = rows.schema["k"].dataType.simpleString()
    seen = rows.withColumn("th", F.xxhash64("t")).mapInArrow(lean(measured, "t"), f"h bigint, k {kind}, quality int, th bigint, x array<double>")
    got = sorted((r.h, list(r.x), r.quality) for r in seen.groupBy("h", "k", "quality").agg(F.min_by("x", F.struct("th", "x")).alias("x")).collect())
    return fit(np.array([r[1] for r in got]), np.array([r[2] for r in got]))


def quality_scores(documents: DataFrame, model: dict, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Every document's held_out, score and predicted, beside the columns in keep (default: the key).

    Only the whole text is scored; null and empty texts get the score of zero features, rows with a null key are not
    held out. Equal texts get equal scores, and a score of just 0.7 is predicted 1. Repeated rows stay; columns in keep
    may have any name but those returned; an empty table gives no rows.
    """
    keep = [key] if keep is None else keep
    spark = documents.sparkSession
    rows = documents.select(*keep, fold(key, 4, 2).alias("held_out"), text_bytes().alias("_bytes"))
    sent = spark.sparkContext.broadcast(model)
    names = [*keep, "held_out"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(sent.value, b.column("_bytes").to_pylist())
            p = (s >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s), pa.array(p)], names=[*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_bytes")
    return rows.mapInArrow(lean(scored, "_bytes"), f"{fields}, score double, predicted int")


