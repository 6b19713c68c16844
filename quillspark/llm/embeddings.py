"""Near-duplicate vectors by PCA-ordered tiled comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, lean, stored
from .components import components

TILE = 4096
ROWS = 512  # of a tile compared at a time
CELL_DIMS = 4  # at most
COPY = 200  # comparisons that a further copy of a row is worth
LEAD = (8, 24)  # leading dimensions after which pairs are bounded
SLACK = 1e-4  # leading products are in single precision


def comparable(vector: str, label: str, key: str) -> Column:
    """Not null, no null or non-finite component, not zero, with a label and an id."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of one length in double precision."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled to length 1, by the largest component first, so that squares neither overflow nor vanish."""
    y = x / np.abs(x).max(1, keepdims=True)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    n = pc.list_value_length(column).to_numpy()
    for d in np.unique(n):
        yield int(d), np.flatnonzero(n == d)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by vector length, from the second moments of all rows (summed on the cluster)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, rows in _by_length(b.column(0)):
                u = np.hstack([_unit(_rows(b.column(0).take(pa.array(rows)), d)), np.ones((len(rows), 1))])
                total[d] = total.get(d, 0) + u.T @ u
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d)), pa.array(np.arange(m.size)), pa.array(m.reshape(-1))], names=["d", "i", "v"])

    sums = vectors.select("v").mapInArrow(lean(moments, None), "d bigint, i bigint, v double").groupBy("d", "i").agg(F.sum("v").alias("v"))
    got: dict[int, dict[int, float]] = {}
    for r in sums.collect():  # (length + 1) squared numbers for each length
        got.setdefault(r.d, {})[r.i] = r.v
    out = {}
    for d, values in got.items():
        m = np.array([values[i] for i in range((d + 1) ** 2)]).reshape(d + 1, d + 1)
        mean = m[d, :d] / m[d, d]
        out[d] = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))[1][:, ::-1].copy()
    return out


def _cells(lead: np.ndarray, near: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows, their cells over the columns of lead, and whether these are their own: each row's own cell, and the
    neighbouring cells closer than near. A cell's number has 15 bits for each axis."""
    width = max(2 * near, 1e-3)
    own = np.floor(lead / width).astype(np.int64)
    inside = lead - own * width
    for move in product((0, -1, 1), repeat=lead.shape[1]):
        m = np.array(move, dtype=np.int64)
        rows = np.flatnonzero((((m == 0) | ((m < 0) & (inside <= near)) | ((m > 0) & (width - inside <= near)))).all(1))
        if len(rows):
            at = own[rows] + m + (1 << 14)
            yield rows, (at << (15 * np.arange(lead.shape[1]))).sum(1), not m.any()


def links(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have cosine >= least. ux, uy: unit rows on the principal axes.

    Products of the leading dimensions come first; what the others can add is at most the product of the
    suffixes' norms. Rows without a pair that can still reach the threshold go; the others are decided on
    x and y themselves.
    """
    out = np.zeros((len(x), len(y)), dtype=bool)
    rows, cols = np.arange(len(x)), np.arange(len(y))
    got, start = np.float32(0), 0
    for stop in [k for k in LEAD if k < x.shape[1]]:
        got = got + ux[rows, start:stop] @ uy[cols, start:stop].T
        left, right = (np.sqrt((u[:, stop:] ** 2).sum(1)) for u in (ux[rows], uy[cols]))
        open_ = got + np.outer(left, right) >= np.float32(least - SLACK)
        r, c = open_.any(1), open_.any(0)
        rows, cols, got, start = rows[r], cols[c], got[np.ix_(r, c)], stop
        if not len(rows):
            return out
    a, b = x[rows], y[cols]
    # scaled by their largest components, so that squares neither overflow nor vanish
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    cos = (a @ b.T) / np.outer(na, nb)
    hit = cos >= least
    edge = np.argwhere(np.abs(cos - least) < 1e-12)
    for i, j in edge:
        hit[i, j] = math.fsum(a[i] * b[j]) / (math.sqrt(math.fsum(a[i] * a[i])) * math.sqrt(math.fsum(b[j] * b[j]))) >= least
    out[np.ix_(rows, cols)] = hit
    return out


def _forest(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, least node joined with it) within one tile."""
    la, lb = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(hit, lb[None], top).min(1, initial=top))
        nb = np.minimum(lb, np.where(hit, na[:, None], top).min(0, initial=top))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return [*zip(a[la < a].tolist(), la[la < a].tolist(), strict=True), *zip(b[lb < b].tolist(), lb[lb < b].tolist(), strict=True)]


def near_vectors(df: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """key, n_links (other vectors with cosine >= least and the same label), component_id (least key reachable
    by links), kept (key = component_id).

    Equal vectors of a label are one node with a weight. Cells over the first principal axes hold their own
    nodes and those near their border; a label has as many axes as save comparisons, none where vectors spread over all
    axes alike. A cell is compared tile by tile, each two tiles once; a task holds two tiles and gives
    counts and the edges of a forest, never pairs. Vectors that are null, zero, empty, or hold a null or
    non-finite component, and rows with a null label, link with nothing; vectors of different lengths neither.
    A null key links with nothing: component_id is null and kept true. Rows that share a key are one node,
    each with its own links. Other columns are not read; an empty table gives no rows.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.col(label).alias("g"))
    rows = rows.withColumn("ok", comparable("v", "g", "id"))
    nodes = stored(rows.where("ok").groupBy("g", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size")).withColumn("d", F.size("v")), "vectors")
    nodes = nodes.withColumn("at", F.monotonically_increasing_id())
    sent = df.sparkSession.sparkContext.broadcast(axes(nodes))
    near = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    kinds = dict(nodes.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each label: how many rows a cell owns and holds, by the number of axes."""
        for b in batches:
            for d, rows in _by_length(b.column("v")):
                part = b.take(pa.array(rows))
                lead = _unit(_rows(part.column("v"), d)) @ sent.value[d][:, :CELL_DIMS]
                for k in range(lead.shape[1] + 1):
                    for i, cell, mine in _cells(lead[:, :k], near):
                        n = len(i)
                        t = pa.table({"g": part.column("g").take(pa.array(i)), "d": np.full(n, d, np.int32), "k": np.full(n, k, np.int32), "cell": cell, "own": np.full(n, int(mine)), "every": np.ones(n, np.int64)})
                        t = t.group_by(["g", "d", "k", "cell"]).aggregate([("own", "sum"), ("every", "sum")]).select(["g", "d", "k", "cell", "own_sum", "every_sum"])
                        yield from t.rename_columns(["g", "d", "k", "cell", "own", "every"]).combine_chunks().to_batches()

    counts = nodes.select("g", "v").mapInArrow(lean(count, None), f"g {kinds['g']}, d int, k int, cell bigint, own bigint, every bigint")
    counts = counts.groupBy("g", "d", "k", "cell").agg(F.sum("own").alias("own"), F.sum("every").alias("every"))
    costs = counts.groupBy("g", "d", "k").agg((F.sum(F.col("every").cast("double") * F.col("every")) / 2 + COPY * F.sum("every")).alias("cost"))
    best = costs.groupBy("g", "d").agg(F.min_by("k", F.struct("cost", "k")).alias("k"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, k = (b.column(n).to_numpy() for n in ("d", "k"))
            for width, dims in sorted(set(zip(d.tolist(), k.tolist(), strict=True))):
                part = b.take(pa.array(np.flatnonzero((d == width) & (k == dims))))
                lead = _unit(_rows(part.column("v"), width)) @ sent.value[width][:, :dims]
                for i, cell, mine in _cells(lead, near):
                    t = part.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([t.column("g"), t.column("d"), pa.array(cell), pa.array(np.full(len(i), mine)), *(t.column(n) for n in ("at", "node", "size", "v"))], names=["g", "d", "cell", "own", "at", "node", "size", "v"])

    placed = nodes.join(best, ["g", "d"]).select("g", "d", "k", "at", "node", "size", "v")
    placed = stored(placed.mapInArrow(lean(place, None), f"g {kinds['g']}, d int, cell bigint, own boolean, at bigint, node bigint, size bigint, v {kinds['v']}"), "cells")
    tiles = placed.groupBy("g", "d", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("nt"), F.max("own").alias("some")).where("some").drop("some")
    both = placed.join(tiles, ["g", "d", "cell"]).withColumn("tile", F.pmod(F.xxhash64("at"), F.col("nt")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, nt - 1)")))
    both = both.select("g", "d", "cell", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "own", "at", "node", "size", "v")

    def compare(t: pa.Table) -> pa.Table:
        i, j, d = (t.column(n)[0].as_py() for n in ("i", "j", "d"))
        tiles, at, node, size = (t.column(n).to_numpy() for n in ("tile", "at", "node", "size"))
        own = t.column("own").to_numpy(zero_copy_only=False)
        v = _rows(t.column("v"), d)
        p = (_unit(v) @ sent.value[d]).astype(np.float32)
        a, b = np.flatnonzero(tiles == i), np.flatnonzero(tiles == j)
        n, edges = np.zeros(len(at), dtype=np.int64), []
        for lo in range(0, len(a), ROWS):
            x = a[lo : lo + ROWS]
            hit = links(v[x], v[b], p[x], p[b], least)
            if i == j:  # each two rows once, and none with itself
                hit &= b[None] > x[:, None]
            if hit.any():
                n[x] += hit @ size[b]
                n[b] += size[x] @ hit
                edges += _forest(hit, node[x], node[b])
        seen = np.flatnonzero((n > 0) & own)
        cols = [[False] * len(seen) + [True] * len(edges), [*at[seen].tolist(), *(e[0] for e in edges)], [*n[seen].tolist(), *(e[1] for e in edges)]]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["edge", "a", "b"])

    found = stored(both.groupBy("g", "d", "cell", "i", "j").applyInArrow(compare, "edge boolean, a bigint, b bigint"), "tiles")
    counts = found.where("not edge").groupBy(F.col("a").alias("at")).agg(F.sum("b").alias("n"))
    joined = components(found.where("edge").select("a", "b"))
    classes = nodes.join(counts, "at", "left").join(joined, "node", "left")
    classes = classes.select("g", "v", "node", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"))
    dropped(placed)
    out = rows.where("ok").join(classes, ["g", "v"]).select("id", "n", "component")
    rest = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n"), F.col("id").alias("component"))
    out = out.unionByName(rest)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
