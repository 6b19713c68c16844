"""Connected components of an edge table that never leaves the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import dropped, stored

BLOCK = 1 << 20  # edges that a task joins at a time


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges as arrays: each node that isn't the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) as forests of stars, block by block: fewer edges that join the same nodes."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> pa.RecordBatch:
        u, v = joined(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        held.append(b)
        size += len(b)
        if size >= BLOCK:
            yield out()
            size = 0
    if held:
        yield out()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct edges as a table, with their number and the sum of their hashes."""
    seen = Observation()
    marked = edges.mapInArrow(_forests, "u bigint, v bigint").distinct()
    out = stored(marked.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    got = seen.get
    return out, (got["n"], got["h"])


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, component of every node of the edges (a, b): the least node reachable.

    Alternating large and small stars: each round hangs neighbours on the least node seen, joins within tasks what a
    task holds, and is a table in the shared folder. Loops and edges with nulls are left out. A hub's rows are
    summed before they are shuffled, and joins on it can be split. Raises if that many rounds don't settle it;
    the number needed grows with the logarithm of the longest path.
    """
    e, mark = _kept(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    settled = mark[0] == 0
    while not settled:
        if not rounds:
            raise RuntimeError("components did not settle")
        rounds -= 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # larger neighbours hang on a node's least neighbour, and so does the node itself
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        large = large.where("u <> v")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node's smaller neighbours hang on the least of them
        turned = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new, old = _kept(turned.unionByName(small.select("u", F.col("m").alias("v")))), mark
        dropped(e)
        e, mark = new
        settled = mark[0] == 0 or mark == old
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
