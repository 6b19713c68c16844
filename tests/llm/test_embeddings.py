import math
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import embeddings as E

from .helpers import union_find


def rows():
    rng = np.random.default_rng(2)
    out = []
    for i in range(150):
        out.append((i, rng.normal(size=8).astype(np.float32).tolist(), int(rng.integers(0, 3))))
    for i in range(150, 260):
        base = np.array(out[i % 6][1])
        out.append((i, (base * rng.uniform(0.1, 9) + rng.normal(size=8) * 0.1 * rng.random()).astype(np.float32).tolist(), out[i % 6][2]))
    out += [(300 + i, out[7][1], out[7][2]) for i in range(5)] + [(310, out[7][1], None), (311, out[7][1], 99)]
    out += [(320, None, 1), (321, [0.0] * 8, 1), (322, [0.0] * 8, 1), (323, [float("nan")] * 8, 1), (324, [float("inf")] + [1.0] * 7, 1), (325, [None] + [1.0] * 7, 1), (326, [], 1), (327, [1.0, 2.0], 1), (328, [1.0, 2.0], 1)]
    out += [(330, [1e-30] * 8, 2), (331, [3e30] * 8, 2)]
    return out


def brute(data):
    def ok(v):
        return v is not None and None not in v and all(map(math.isfinite, v)) and any(v)

    n, links = Counter(), []
    for i, (a, v, g) in enumerate(data):
        for b, w, h in data[:i]:
            if g is None or g != h or not ok(v) or not ok(w) or len(v) != len(w):
                continue
            dot = lambda x, y: math.fsum(p * q for p, q in zip(x, y))
            if dot(v, w) / math.sqrt(dot(v, v)) / math.sqrt(dot(w, w)) >= 0.98:
                n.update((a, b))
                links.append((a, b))
    return n, union_find([r[0] for r in data], links)


@pytest.mark.parametrize("tile,copy", [(E.TILE, E.COPY), (16, E.COPY), (E.TILE, 0), (16, 0)])
def test_brute_force(spark, monkeypatch, tile, copy):
    monkeypatch.setattr(E, "COPY", copy)  # 0: as many axes as ever help
    data = rows()
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").repartition(3)
    n, c = brute(data)
    for r in E.near_vectors(df, tile=tile).collect():
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], c[r.vec_id], c[r.vec_id] == r.vec_id), r


def test_cells_hold_every_near_pair():
    """Each two rows closer than near meet in the cell of either one, once."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (300, 3))
    for k in range(4):
        own, every = {}, {}
        for rows_, cells, mine in E._cells(x[:, :k], 0.1):
            for r, c in zip(rows_.tolist(), cells.tolist()):
                every.setdefault(c, []).append(r)
                if mine:
                    own[r] = c
        assert len(own) == 300 and all(len(v) == len(set(v)) for v in every.values())
        for a in range(300):
            assert set(np.flatnonzero(np.sqrt(((x[:, :k] - x[a, :k]) ** 2).sum(1)) < 0.1)) <= set(every[own[a]])


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5, 6), (None, [1.0, 0.0], 1, 5, 6)], "vec_id bigint, embedding array<float>, label int, node int, n int")
    assert sorted(tuple(r) for r in E.near_vectors(df).collect() if r.vec_id) == [(1, 0, 1, True)]
    assert [tuple(r) for r in E.near_vectors(df).collect() if r.vec_id is None] == [(None, 0, None, True)]
    assert E.near_vectors(df.limit(0)).collect() == []
