import itertools
import random

import numpy as np
import pytest

from quillspark.llm import minhash as M
from quillspark.llm.components import components

from .helpers import DOCS, odd_documents, prose, union_find, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if any(p and q and 100 * len(p & q) >= percent * len(p | q) for p in x for q in y)]
    return union_find(sets, links)


def chains(seed=4):
    """Groups of near copies: chains whose ends differ, and stars."""
    rng, rows, i = random.Random(seed), [], 5000
    for _ in range(6):
        w = prose(rng, rng.randint(40, 150)).split(" ")
        for _ in range(25):
            w = list(w)
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((i, " ".join(w), "en", "s", 0))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,docs", [(85, M.BLOCK_DOCS), (80, M.BLOCK_DOCS), (85, 8)])
def test_brute_force(spark, percent, docs):
    rows = odd_documents() + chains()
    got = M.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4), percent, block_docs=docs).collect()
    assert len(got) == len(rows)
    want = brute(rows, percent)
    by = {}
    for i, t, *_ in rows:
        by.setdefault(i, set()).add(len(shingles(t)))
    for r in got:
        assert r.n_shingles in by[r.doc_id]
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n, share in ((4, 0.5), (40, 0.8), (400, 0.3), (3000, 0.6)):
        found = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            k = round(2 * n * share / (1 + share))
            a, b = x[:n], np.concatenate([x[:k], x[n : 2 * n - k]])
            s = M.signatures([a, b])
            assert np.isfinite(s).all()
            found.append((s[0] == s[1]).mean() - k / (2 * n - k))
        assert abs(np.mean(found)) < 0.04
    assert np.isinf(M.signatures([np.zeros(0, np.uint64)])).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if None not in (a, b) and a != b]
    assert got == union_find({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], DOCS), 85).collect() == []
