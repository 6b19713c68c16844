import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import substrings as S

from .helpers import DOCS, odd_documents, prose


def brute(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def documents():
    rng = random.Random(1)
    rows = {r[0]: r[1] for r in odd_documents() if r[0] is not None}
    passages = [prose(rng, k) for k in (15, 18, 25, 60)]
    for i in range(200, 260):
        parts = [prose(rng, rng.randint(0, 30)), rng.choice(passages), prose(rng, rng.randint(0, 30)), rng.choice(passages)[rng.randint(0, 30) :], prose(rng, 4)]
        rows[i] = " ".join(parts)
    rows |= {300: "x" * 5000, 301: "ab" * 333, 302: rows[204] + rows[205], 303: "é" * 400, 304: "y" * 99, 305: "z" * 100, 306: "z" * 100}
    return list(rows.items())


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_brute_force(spark, hot):
    rows = documents()
    df = spark.createDataFrame([(i, t, "l", "s", 0) for i, t in rows], DOCS).repartition(5)
    got = {r.doc_id: tuple(r)[1:5] for r in S.repeats_removed(df, hot=hot).collect()}
    assert got == brute(rows)


def factors(parts):
    """Text with ends, all starts, their ends, and by comparison of all pairs the longest previous factor."""
    text = np.array([x for p in parts for x in [*(b + 1 for b in p), 0]], dtype=np.uint16)
    starts, ends, at = [], [], 0
    for p in parts:
        starts += range(at, at + len(p))
        ends += [at + len(p)] * len(p)
        at += len(p) + 1
    best = []
    for i, e in zip(starts, ends):
        most = 0
        for j, f in zip(starts, ends):
            if j < i:
                k = 0
                while i + k < e and j + k < f and text[i + k] == text[j + k]:
                    k += 1
                most = max(most, k)
        best.append(most)
    return text, np.array(starts), np.array(ends), best


@pytest.mark.parametrize("parts", [
    [b"a" * 60, b"a" * 31], [b"ab" * 30, b"ba" * 12, b"b"], [b"abc" * 20 + b"abd" * 20], [b"\0" * 40, b"\xff\0" * 20, b"\0"], [b"x"], [b"abracadabra", b"abracadabra", b"cadabrac", b"zz"],
])
def test_previous_factors_of_periodic_texts(parts):
    text, starts, ends, best = factors(parts)
    assert S.previous_factors(text, starts, ends).tolist() == best


def test_previous_factors_of_random_texts():
    rng = random.Random(5)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab" if rng.random() < 0.9 else b"abc") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        text, starts, ends, best = factors(parts)
        assert S.previous_factors(text, starts, ends).tolist() == best
        ranks = S.suffix_ranks(text, len(text))
        order = np.argsort(ranks[-1][1], kind="stable")
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        lcp = S.common_lengths(text, ranks, order[:-1], order[1:]).tolist()
        for a, b, n in zip(order, order[1:], lcp):
            assert (text[a : a + n] == text[b : b + n]).all() and (max(a, b) + n == len(text) or text[a + n] != text[b + n])
        to, low = S.smaller_before(order, np.array([0, *lcp]))
        for k, t in enumerate(to):
            smaller = [i for i in range(k) if order[i] < order[k]]
            assert t == max(smaller, default=-1) and low[k] == (min(lcp[t:k]) if smaller else 0)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 300)
    rows = documents()
    batch = [S.anchors(d)[3].tolist() for _, t in rows for _, d in S.pieces((t or "").encode())]
    assert sum(x[-1] + 1 for x in batch) == sum(max(0, len((t or "").encode()) - 99) for _, t in rows)


def test_repeated_rows_nulls_and_empty(spark):
    rng = random.Random(3)
    text = prose(rng, 60)
    df = spark.createDataFrame([(1, text, "", "", 0), (1, text, "", "", 0), (None, text, None, None, None), (2, None, None, None, None)], DOCS)
    got = sorted((r.doc_id or 9, r.n_bytes, r.n_removed) for r in S.repeats_removed(df).collect())
    n = len(text)
    assert got == [(1, n, 0), (1, n, 0), (2, 0, 0), (9, n, n)]
    assert S.repeats_removed(df.limit(0)).collect() == []
