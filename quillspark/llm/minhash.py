"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, gram_hashes, lean, mixed, stored, text_bytes, word_hashes, words
from .components import components

SHINGLE = 5
RANKS = 128
MISS = 1e-6  # of a pair just at the threshold
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 2_000_000
SURE = 5  # standard deviations by which a signature's estimate may fall short of the threshold
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """The document's set as sorted 64-bit hashes: its distinct 5-word shingles; fewer words are one shingle."""
    h = word_hashes(words(text))
    if not len(h):
        return h
    return np.unique(gram_hashes(h, tuple(range(min(SHINGLE, len(h))))) + np.uint64(max(0, SHINGLE - len(h))))


def signatures(sets: list[np.ndarray], ranks: int = RANKS) -> np.ndarray:
    """SuperMinHash: each element walks its own random permutation of the registers, and the j-th register it
    meets gets the rank j plus a random fraction; a register keeps the least. Values of step j are below those of
    any later step, so a set whose registers are all filled stops. Empty sets keep infinity."""
    out = np.full((len(sets), ranks), np.inf)
    flat, live = out.reshape(-1), [i for i, s in enumerate(sets) if len(s)]
    if not live:
        return out
    e = np.concatenate([sets[i] for i in live])
    doc = np.repeat(np.array(live), [len(sets[i]) for i in live])
    perm = None
    for j in range(ranks):
        x = mixed(e + np.uint64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(ranks - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            target = k
        else:
            at = np.arange(len(e))
            target = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
        np.minimum.at(flat, doc * ranks + target, j + (x >> np.uint64(32)) / 2.0**32)
        open_ = np.isinf(out).any(1)
        go = open_[doc]
        if not go.any():
            break
        if perm is None:
            e, doc, k = e[go], doc[go], k[go]
            perm = np.tile(np.arange(ranks, dtype=np.uint8), (len(e), 1))
            perm[np.arange(len(e)), k] = 0
        elif not go.all():
            e, doc, perm = e[go], doc[go], perm[go]
    return out


def banding(threshold: float, ranks: int = RANKS, miss: float = MISS) -> tuple[int, int]:
    """The longest bands, and their number, with which a pair at the threshold is missed less often than miss."""
    rows = max((r for r in range(1, 17) if (1 - threshold**r) ** (ranks // r) <= miss), default=1)
    return rows, ranks // rows


def band_hashes(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    x = mixed(sig[:, : rows * bands].reshape(len(sig), bands, rows).view(np.uint64))
    odd = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mixed((x * odd).sum(2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _GOLD).view(np.int64)


def _chunks(sets: list[np.ndarray], most: int = 300_000) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, s in enumerate(sets):
        if size and size + len(s) > most:
            yield start, i
            start, size = i, 0
        size += len(s)
    yield start, len(sets)


def sketches(documents: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set, null if empty), the hashes of the signature's bands, and the
    signature itself with a byte of each register."""
    rows, bands = banding(percent / 100)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column("_bytes").to_pylist()]
            sig = [signatures(sets[i:j]) for i, j in _chunks(sets)]
            hashes = np.concatenate([band_hashes(x, rows, bands) for x in sig])
            short = np.concatenate([_short(x, np.uint8) for x in sig])
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(hashes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists, pa.array([x.tobytes() for x in short], pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "sig"])

    return documents.select("doc_id", text_bytes().alias("_bytes")).mapInArrow(lean(sketch, "_bytes"), "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sig binary")


def _short(sig: np.ndarray, kind: type) -> np.ndarray:
    """The leading bits of each register's hash."""
    return (mixed(sig.view(np.uint64)) >> np.uint64(64 - 8 * np.dtype(kind).itemsize)).astype(kind)


def _least(percent: int) -> float:
    """Registers that agree, but for one in some millions, for sets at the threshold."""
    t = percent / 100
    return (t - SURE * math.sqrt(t * (1 - t) / RANKS)) * RANKS


def alike(nodes: np.ndarray, labels: np.ndarray, sig: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that join all nodes whose signatures may belong to linked sets. What is reached is compared with what
    isn't yet: no pair twice, and copies of one text once."""
    labels = np.unique(labels, return_inverse=True)[1]
    least, out = _least(percent), []
    rest = np.arange(len(nodes))
    while len(rest):
        front = rest[labels[rest] == labels[rest[0]]]
        rest = rest[labels[rest] != labels[rest[0]]]
        while len(front) and len(rest):
            x, front = front[0], front[1:]
            hit = (sig[rest] == sig[x]).sum(1) >= least
            if not hit.any():
                continue
            out += [(int(nodes[x]), int(nodes[y])) for y in rest[hit]]
            # what was joined beforehand comes along
            more = np.isin(labels[rest], labels[rest[hit]])
            front, rest = np.concatenate([front, rest[more]]), rest[~more]
    return out


def linked(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all that links join: each found pair is confirmed on the full sets; pairs that are
    already joined are skipped. labels: what is joined beforehand."""
    labels = np.unique(labels, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    sig = np.concatenate([_short(signatures(sets[i:j]), np.uint16) for i, j in _chunks(sets)])
    least = _least(percent)
    out = []
    for x in range(len(sets)):
        rest = x + 1 + np.flatnonzero(labels[x + 1 :] != labels[x])
        rest = rest[(100 * np.minimum(size[rest], size[x]) >= percent * np.maximum(size[rest], size[x])) & (size[rest] > 0)]
        if not len(rest):
            continue
        rest = rest[(sig[rest] == sig[x]).sum(1) >= least]
        for y in rest:
            if labels[y] == labels[x]:
                continue
            common = _common(sets[x], sets[y])
            if 100 * common >= percent * (size[x] + size[y] - common):
                out.append((int(nodes[x]), int(nodes[y])))
                labels[labels == labels[y]] = labels[x]
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _by_texts(nodes: np.ndarray, labels: np.ndarray, texts: list[bytes], percent: int) -> list[tuple[int, int]]:
    return linked(nodes, labels, [shingles(t) for t in texts], percent)


def _by_signatures(nodes: np.ndarray, labels: np.ndarray, sigs: list[bytes], percent: int) -> list[tuple[int, int]]:
    return alike(nodes, labels, np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1), percent)


def _compared(tasks: DataFrame, compare: Callable, percent: int) -> DataFrame:
    """Edges within each (task, coarse) of rows task, coarse, node, label, bytes."""

    def run(t: pa.Table) -> pa.Table:
        coarse, node, label = (t.column(n).to_numpy() for n in ("coarse", "node", "label"))
        data, edges = t.column("bytes"), []
        order = np.argsort(coarse, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(coarse[order])) + 1) if len(order) else []:
            rows = rows[np.lexsort((node[rows], label[rows]))]
            edges += compare(node[rows], label[rows], [data[int(i)].as_py() for i in rows], percent)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return tasks.groupBy("task").applyInArrow(run, "a bigint, b bigint")


def _within(members: DataFrame, data: DataFrame, compare: Callable, percent: int, block_docs: int, block_weight: int) -> DataFrame:
    """Edges (a, b) within groups of members (node, coarse, n) by compare on their data (node, bytes).

    Small groups share tasks; a large one is compared in blocks that all hold some common nodes, and then block
    against block for what isn't joined yet: no group is ever one task's, and pairs aren't rows.
    """
    sizes = members.groupBy("coarse").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"),
        F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node")), F.max_by("node", F.xxhash64("node")))).alias("hubs"),
    ).where("k > 1").withColumn("nb", F.ceil(F.greatest(F.col("k") / block_docs, F.col("total") / block_weight)).cast("int"))
    sizes = stored(sizes, "sizes")
    total, most, count = sizes.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.max("nb"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    tasks = max(1, math.ceil(max(2 * total / block_weight, 2 * count / block_docs))) + 7
    placed = members.join(sizes, "coarse").withColumn(
        "blocks", F.when(F.col("nb") == 1, F.array(F.lit(0))).when(F.array_contains("hubs", F.col("node")), F.expr("sequence(0, nb - 1)")).otherwise(F.array(F.expr("cast(pmod(xxhash64(node), nb) as int)")))
    )
    small = F.concat(F.lit("s"), F.pmod(F.xxhash64("coarse"), F.lit(tasks)).cast("string"))
    placed = placed.select("node", "coarse", F.explode("blocks").alias("block"), "nb", F.col("node").alias("label"))
    placed = placed.select("node", "coarse", "label", F.when(F.col("nb") == 1, small).otherwise(F.concat_ws(":", "coarse", "block")).alias("task"))
    links = stored(_compared(placed.join(data, "node"), compare, percent), "links")
    if most > 1:
        links = links.unionByName(stored(_across(members, sizes, components(links), data, compare, percent, block_docs, block_weight), "links"))
    return links


def near_duplicates(documents: DataFrame, percent: int, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked, directly or through others), kept.

    Documents with 100 * |intersection| >= percent * |union| of their shingle sets are linked. Documents
    with equal sets are one node before anything is compared. Nodes that share a band's hash with its least node meet
    in that node's group, where signatures are compared; what they join (estimates far enough below the threshold
    don't) goes on, and links are confirmed on full sets.
    Texts without words (null, empty) have n_shingles 0 and are their own component. A null doc_id links with
    nothing: component_id is null, kept true. Rows that share a doc_id are one document and all kept if it is.
    Extra columns are not read; an empty table gives no rows.
    """
    sketch = stored(sketches(documents, percent), "sketches")
    real = sketch.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(real.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other")
    stars = stored(banded.join(hubs, "band").select("node", F.col("hub").alias("coarse")).distinct().withColumn("n", F.lit(1)), "stars")
    near = _within(stars, classes.select("node", F.col("sig").alias("bytes")), _by_signatures, percent, block_docs, block_docs)
    coarse = stored(components(near).withColumnRenamed("component", "coarse"), "coarse")
    members = coarse.join(classes.groupBy("node").agg(F.sum("n").alias("n")), "node").select("node", "coarse", "n")
    texts = documents.select(F.col("doc_id").alias("node"), text_bytes().alias("bytes")).where(F.col("node").isNotNull())
    found = components(_within(members, texts, _by_texts, percent, block_docs, block_shingles))
    dropped(stars)
    rows = sketch.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", F.col("node").alias("rep")), "set_key", "left")
    rows = rows.join(found, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across(members: DataFrame, sizes: DataFrame, found: DataFrame, data: DataFrame, compare: Callable, percent: int, block_docs: int, block_weight: int) -> DataFrame:
    """Links between the blocks of groups too large for one task, for nodes not joined yet.

    Blocks are dealt anew by what is joined: a large joined part fills blocks of its own, and two of its own
    blocks need no comparison. What is left is the unjoined nodes against the rest of their group.
    """
    m = members.join(sizes.where("nb > 1").select("coarse"), "coarse").join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    parts = m.groupBy("coarse", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    parts = parts.withColumn("own", F.ceil(F.greatest(F.col("k") / block_docs, F.col("total") / block_weight)).cast("int"))
    mixed_ = parts.where("own = 1").groupBy("coarse").agg(F.ceil(F.greatest(2 * F.sum("k") / block_docs, 2 * F.sum("total") / block_weight)).cast("int").alias("shared"))
    at = parts.select("coarse", "label", "own").join(mixed_, "coarse", "left")
    dealt = m.join(at, ["coarse", "label"]).select(
        "coarse", "label", "node",
        F.when(F.col("own") > 1, F.concat_ws("/", F.col("label"), F.expr("pmod(xxhash64(node), own)"))).otherwise(F.concat(F.lit("m"), F.expr("pmod(xxhash64(label), shared)"))).alias("block"),
    )
    dealt = stored(dealt, "dealt")
    blocks = dealt.groupBy("coarse", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    other = blocks.select("coarse", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = blocks.join(other, "coarse").where("block <= block2 and not (lo = hi and lo2 = hi2 and lo = lo2)")
    pairs = pairs.select("coarse", F.concat_ws("|", "coarse", "block", "block2").alias("task"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return _compared(dealt.join(pairs, ["coarse", "block"]).select("node", "coarse", "label", "task").join(data, "node"), compare, percent)
