import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import lm as L

from .helpers import DOCS, crc, odd_documents, prose, words


def test_counts_and_base(spark):
    rows = odd_documents()
    counts = Counter()
    for i, t, *_ in rows:
        if i is None or crc(i) % 7 != 2:
            counts.update([*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    by = {r[0]: r[1] for r in rows}
    got = L.scores(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = [*words(by[r.doc_id]), "\n"]
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0


def test_tail_is_joined(spark, monkeypatch):
    rows = odd_documents()
    df = spark.createDataFrame(rows, DOCS)
    whole = sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6)) for r in L.scores(df).collect())
    monkeypatch.setattr(L, "HEAD", 40)
    monkeypatch.setattr(L, "MOST_COUNTED", 50)
    assert sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6)) for r in L.scores(df).collect()) == whole


def test_normalised():
    """Blocked scores over classes and their words sum to 1 and are the plain softmaxes."""
    rng = np.random.default_rng(1)
    uni = rng.random(50)
    for single, run in ((8, 9), (50, 1)):
        m = L.Model(50, uni / uni.sum(), single=single, run=run)
        m.R, m.Q, m.C = (rng.normal(0, 1, x.shape).astype(np.float32) for x in (m.R, m.Q, m.C))
        contexts = rng.integers(0, 50, (40, L.CONTEXT))
        lp = np.array([[m.log_p(np.append(x, w))[0] for w in range(50)] for x in contexts])
        run = rng.integers(0, 50, 300)
        assert np.allclose(m.log_p(run), [m.log_p(run[k : k + L.CONTEXT + 1])[0] for k in range(300 - L.CONTEXT)], atol=1e-4)
        assert np.allclose(np.exp(lp).sum(1), 1, atol=1e-4)
        h = sum(m.R[contexts[:, k]] * m.C[k] for k in range(L.CONTEXT))
        z = h @ m.Q[: m.top].T + m.bias[: m.top]
        z = z - np.log(np.exp(z).sum(1, keepdims=True))
        assert np.allclose(lp[:, :single], z[:, :single], atol=1e-3)


def test_untrained_is_unigram():
    uni = np.random.default_rng(2).random(50)
    uni /= uni.sum()
    m = L.Model(50, uni, single=8, run=9)
    assert np.allclose([np.exp(m.log_p(np.append(np.zeros(L.CONTEXT, int), w))[0]) for w in range(50)], uni, atol=1e-4)


def test_frequent(spark):
    """Never more than asked for, never far fewer, the most frequent first; also where all are equally frequent."""
    rng = random.Random(9)
    for rows in ([(f"t{i}".encode(), 7) for i in range(3000)], [(f"t{i}".encode(), rng.choice([1, 2, 2, 50, 51, 900])) for i in range(3000)]):
        df = spark.createDataFrame(rows, "token binary, c bigint")
        for most in (100, 1000, 5000):
            got = L.frequent(df, most)
            assert min(most, 3000) - 5 <= len(got) <= most
            ranked = sorted((c for _, c in rows), reverse=True)
            assert [c for _, c in got] == ranked[: len(got)]
    assert L.frequent(df.limit(0), 5) == []


def test_beats_base_on_prose(spark):
    """Held-out prose in three invented languages: the model's context tells the language, counts don't."""
    rng = random.Random(11)
    languages = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(800)] for letters in ("abcdefg", "hijklmn", "opqrstu")]
    weights = [1 / (k + 3) for k in range(800)]
    rows = [(i, " ".join(rng.choices(languages[i % 3], weights, k=rng.randint(20, 400))), "x", "s", 0) for i in range(600)]
    held = [r for r in L.scores(spark.createDataFrame(rows, DOCS)).collect() if r.held_out]
    assert held and sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_beats_base_on_the_tables(spark):
    """On the driver's documents, where they are there."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    held = L.scores(spark.read.parquet(path)).where("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_same_in_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 2000)
    monkeypatch.setattr(L, "PER_WORD", 0)
    df = spark.createDataFrame(odd_documents(), DOCS)
    one, other = (sorted((str(r.doc_id), r.score) for r in L.scores(df.repartition(n)).collect()) for n in (1, 5))
    assert [r[0] for r in one] == [r[0] for r in other]
    assert np.allclose([r[1] for r in one], [r[1] for r in other], rtol=1e-6)


def test_clashing_columns(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, DOCS)
    more = df.selectExpr("*", "1 AS score", "2 AS b", "3 AS held_out", "4 AS token", "5 AS shard", "6 AS h", "7 AS c")
    key = lambda r: (str(r.doc_id), r.base_score)
    assert [round(r.score, 4) for r in sorted(L.scores(more).collect(), key=key)] == [round(r.score, 4) for r in sorted(L.scores(df).collect(), key=key)]


def test_rare_words_told_apart(spark):
    """Beyond the 2,045 most frequent words, the model still tells which word follows which."""
    rng = random.Random(4)
    rows = []
    for i in range(500):
        pairs = [rng.randrange(2500) for _ in range(150)]
        rows.append((i, " ".join(f"a{k} b{k}" for k in pairs), "en", "s", 0))
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    got = {r.doc_id: r for r in L.scores(df).collect()}
    held = [r for k, r in got.items() if r.held_out and k < 500]
    # half of all words are certain; counts alone can't see that
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)


def test_learns_order(spark):
    """Held-out texts with the training texts' word order score better than under counts alone."""
    rng = random.Random(2)
    cycle = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(400):
        k = rng.randrange(30)
        rows.append((i, " ".join(cycle[(k + j) % 30] for j in range(200)), "en", "s", 0))
    got = [r for r in L.scores(spark.createDataFrame(rows, DOCS)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_empty(spark):
    assert L.scores(spark.createDataFrame([], DOCS)).collect() == []
