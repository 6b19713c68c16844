"""Language identification by a byte convolutional network."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, lean, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
STRIDE = WINDOW - max(WIDTHS) + 1  # windows share what a filter may need from both
SAMPLE_BYTES = 3 << 20  # of labelled texts that the fit may take, shared alike by all languages
SLOTS = 1 << 30
UNKNOWN = "und"
_ASCII = re.compile(rb"[A-Za-z]")


def windows(text: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, the last one padded with zeros. Every run of bytes that a filter
    spans lies in one of them."""
    n = 1 + max(0, -(-(len(text) - WINDOW) // STRIDE))
    data = np.frombuffer(text.ljust((n - 1) * STRIDE + WINDOW, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, WINDOW)[::STRIDE]


def has_letter(text: bytes) -> bool:
    return bool(_ASCII.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def fit(texts: list[bytes], langs: list[str], seed: int = 3, epochs: int = 6, least_steps: int = 800) -> dict:
    """Embedding, filters of several widths, ReLU with max pooling, softmax; Adam on cross entropy. Few windows are gone
    over more often than `epochs` times."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.3, (256, EMBED))
    p = {"e": e, **{f"w{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)) for w in WIDTHS}}
    p |= {f"b{w}": np.zeros(FILTERS) for w in WIDTHS}
    p |= {"o": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(names)))), "c": np.zeros(max(1, len(names)))}
    x, y = [], []
    for t, lang in zip(texts, langs, strict=True):
        w = windows(t)
        x.extend(w)
        y.extend([names.index(lang)] * len(w))
    if len(names) > 1:
        x, y = np.array(x), np.array(y)
        m, v, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
        parts = max(1, len(x) // 64)
        for _ in range(max(epochs, -(-least_steps // parts))):
            for ids in np.array_split(rng.permutation(len(x)), parts):
                t += 1
                for k, g in _gradient(p, x[ids], y[ids]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return compiled(p, names)


def _gradient(p: dict, x: np.ndarray, y: np.ndarray) -> dict:
    n = len(x)
    emb = p["e"][x]
    pooled, kept = [], []
    for w in WIDTHS:
        cols = np.concatenate([emb[:, i : WINDOW - w + 1 + i] for i in range(w)], axis=2)
        z = cols @ p[f"w{w}"] + p[f"b{w}"]
        at = z.argmax(1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0]
        pooled.append(np.maximum(top, 0))
        kept.append((cols, at, top > 0))
    h = np.hstack(pooled)
    z = h @ p["o"] + p["c"]
    q = np.exp(z - z.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    q[np.arange(n), y] -= 1
    q /= n
    g = {"o": h.T @ q + 1e-4 * p["o"], "c": q.sum(0), "e": np.zeros_like(p["e"])}
    dh = q @ p["o"].T
    for k, w in enumerate(WIDTHS):
        cols, at, live = kept[k]
        d = dh[:, k * FILTERS : (k + 1) * FILTERS] * live
        rows = cols[np.arange(n)[:, None], at]  # n, filters, w * embed
        g[f"w{w}"] = np.einsum("nf,nfe->ef", d, rows)
        g[f"b{w}"] = d.sum(0)
        back = (d[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
        place = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
        np.add.at(g["e"], place.reshape(-1), back.reshape(-1, EMBED))
    return g


def compiled(p: dict, names: list[str]) -> dict:
    """For prediction: what a filter adds at one byte is a table over byte values, at two neighbours a table over pairs."""
    out = {"names": names, "o": p["o"].astype(np.float32), "c": p["c"].astype(np.float32)}
    for w in WIDTHS:
        t = [(p["e"] @ p[f"w{w}"][i * EMBED : (i + 1) * EMBED]).astype(np.float32) for i in range(w)]
        t[0] = t[0] + p[f"b{w}"].astype(np.float32)
        out[w] = t
    return out


class Predictor:
    def __init__(self, model: dict):
        self.model = model
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        self.pairs = {w: [pair(t[i], t[i + 1]) for i in range(0, w - 1, 2)] for w in WIDTHS if (t := model[w])}

    def _pooled(self, x: np.ndarray) -> np.ndarray:
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            z = self.pairs[w][0].take(two[:, :n], axis=0)
            for j in range(1, w // 2):
                z += self.pairs[w][j].take(two[:, 2 * j : 2 * j + n], axis=0)
            if w % 2:
                z += self.model[w][w - 1].take(x[:, w - 1 :], axis=0)
            out.append(np.maximum(z.max(1), 0))
        return np.hstack(out)

    def __call__(self, texts: list[bytes], block: int = 128) -> tuple[list[str], list[float]]:
        """Softmax of every window of the whole text, averaged by its letters."""
        lang, score, rows, owner = [UNKNOWN] * len(texts), [0.0] * len(texts), [], []
        total = np.zeros((len(texts), len(self.model["c"])))
        weight = np.zeros(len(texts))

        def flush() -> None:
            x, who = np.concatenate(rows), np.concatenate(owner)
            rows.clear()
            owner.clear()
            for i in range(0, len(x), block):
                b, o = x[i : i + block], who[i : i + block]
                z = self._pooled(b) @ self.model["o"] + self.model["c"]
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                k = ((b >= 65) & ((b & 223) >= 65) & ((b & 223) <= 90) | (b >= 128)).sum(1) + 1e-3
                np.add.at(total, o, q * k[:, None])
                np.add.at(weight, o, k)

        held = 0
        live = [i for i, t in enumerate(texts) if has_letter(t)] if self.model["names"] else []
        for i in live:
            rows.append(windows(texts[i]))
            owner.append(np.full(len(rows[-1]), i))
            held += len(rows[-1])
            if held >= 8192:
                flush()
                held = 0
        if rows:
            flush()
        for i in live:
            q = total[i] / weight[i]
            k = int(q.argmax())
            lang[i], score[i] = self.model["names"][k], float(min(1.0, q[k]))
        return lang, score


def train(documents: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Learns from text and lang of documents outside the held-out fold: of every language the rows with the least
    hashes of their id, whole, as long as their texts fit into its share of sample_bytes (one row at least). Null ids,
    texts and langs give nothing; of rows that share an id each counts."""
    rows = documents.select("doc_id", "lang", F.col("text").cast("binary").alias("b")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~fold("doc_id", 5, 0) & F.col("text").rlike(r"\p{L}")
    )
    seen = rows.groupBy("lang").agg(F.sum(F.octet_length("b")).alias("n"), F.count(F.lit(1)).alias("k")).collect()
    share = sample_bytes / max(1, len(seen))
    # about four times what is wanted passes by its hash, sixteen rows at least; of these the least hashes are taken
    h = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    cuts = documents.sparkSession.createDataFrame([(r.lang, math.ceil(SLOTS * min(1.0, max(4 * share / r.n, 16 / r.k)))) for r in seen], "lang string, cut bigint")
    few = rows.withColumn("h", h).join(F.broadcast(cuts), "lang").where("h < cut")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("b"))
    few = few.withColumn("sum", F.sum(F.octet_length("b")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order))
    got = sorted((r.lang, r.h, bytes(r.b)) for r in few.where((F.col("sum") <= share) | (F.col("n") == 1)).select("lang", "h", "b").collect())
    return fit([r[2] for r in got], [r[0] for r in got])


def predicted_language(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its whole text alone.

    und with score 0 for null texts, texts without a letter, and where nothing could be learned.
    Repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    rows = documents.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), text_bytes().alias("_bytes"))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Predictor(sent.value)
        for b in batches:
            lang, score = net(b.column("_bytes").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(lean(predict, "_bytes"), "doc_id bigint, held_out boolean, lang_pred string, score double")
