"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, lean, mixed, stored, text_bytes, word_hashes

STRETCH = 13  # tokens over which an overlap is judged; all tokens of a shorter item
# Four fifths of a stretch's tokens must agree: AGREE of OF.
AGREE, OF = 4, 5
# Fixed masks by the stretch's tokens: 1 counts, 0 is ignored. Whatever tokens of a stretch are replaced, as many as
# the rule allows, one of its masks fits somewhere between them. Of fewer than 5 tokens none may be replaced.
MASKS = {
    13: ("1110010111", "11101111", "11110111", "1111111"),
    12: ("11010111", "111001101", "111111"),
    11: ("1100111", "1101011"),
    10: ("11001011", "110111", "11111"),
    9: ("1101111", "1111011"),
    8: ("110111", "11111"),
    7: ("11011",),
    6: ("11011", "1111"),
    5: ("1011", "111"),
    4: ("1111",),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}
SEEDS = 2_000_000  # seeds of a benchmark that goes to every task; a larger one is joined
PAIRS = 1 << 18  # candidate pairs verified together
CELLS = 1 << 22  # tokens laid side by side at a time
FILTER_BITS = 28  # of the largest filter: 32 MB
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
_BITS = 22


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII bytes; punctuation doesn't count."""
    return _TOKEN.findall(text.lower())


def _offsets(length: int) -> list[tuple[int, ...]]:
    """The masks for an item of that many tokens, as the places that count."""
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS[min(length, STRETCH)]]


def _all_offsets() -> list[tuple[int, ...]]:
    return sorted({o for n in MASKS for o in _offsets(n)})


def _hashes(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Of a mask at every place where it fits; masks have hashes of their own."""
    return mixed(gram_hashes(h, offsets) + np.uint64(sum(1 << o for o in offsets)))


def _spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def verified(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, q: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For pairs of a text h[lo:hi] and an item q[first:first + size] that is laid on h from start on (which may be
    before lo): the number of agreeing tokens, or 0 if no stretch within the text agrees well enough."""
    out = np.zeros(len(lo), dtype=np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(lo):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CELLS, "right")))
        n = size[at:to]
        pair = np.repeat(np.arange(to - at), n)
        own, _ = _spans(n)
        j = np.arange(len(pair)) - own[pair]
        place, a, b = start[at:to][pair] + j, lo[at:to][pair], hi[at:to][pair]
        inside = (place >= a) & (place < b)
        same = inside & (h[np.clip(place, 0, max(0, len(h) - 1))] == q[first[at:to][pair] + j])
        sums = np.concatenate([[0], np.cumsum(same)])
        need = np.minimum(STRETCH, n)[pair]
        whole = inside & (j + need <= n[pair]) & (place + need <= b)
        i = np.flatnonzero(whole)
        good = np.zeros(to - at, dtype=bool)
        good[pair[i[OF * (sums[i + need[i]] - sums[i]) >= AGREE * need[i]]]] = True
        out[at:to] = np.where(good, sums[own + n] - sums[own], 0)
        at = to
    return out


class Seeds:
    """The seeds of benchmark items, by mask."""

    def __init__(self, items: list[tuple[int, bytes]]):
        found = [(i, h) for i, t in items if len(h := word_hashes(tokens(t)))]
        self.ids = np.array([i for i, _ in found], dtype=np.int64)
        self.size = np.array([len(h) for _, h in found], dtype=np.int64)
        self.first, _ = _spans(self.size)
        self.q = np.concatenate([h for _, h in found]) if found else np.zeros(0, np.uint64)
        by: dict[tuple[int, ...], list[tuple[np.ndarray, int]]] = {}
        for k, (_, h) in enumerate(found):
            for offsets in _offsets(len(h)):
                by.setdefault(offsets, []).append((_hashes(h, offsets), k))
        self.tables = {}
        for offsets, rows in by.items():
            hashes = np.concatenate([g for g, _ in rows])
            item = np.concatenate([np.full(len(g), k) for g, k in rows])
            place = np.concatenate([np.arange(len(g)) for g, _ in rows])
            order = np.lexsort((place, item, hashes))
            filled = np.zeros(1 << _BITS, dtype=bool)
            filled[hashes >> np.uint64(64 - _BITS)] = True
            self.tables[offsets] = (filled, hashes[order], item[order], place[order])

    def overlaps(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and agreeing tokens of every pair on a diagonal that verifies."""
        hashed = [word_hashes(tokens(t)) for t in texts]
        size = np.array([len(h) for h in hashed], dtype=np.int64)
        h = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        lo, hi = _spans(size)
        owner = np.repeat(np.arange(len(size)), size)
        out, held, count = [], [], 0

        def flush() -> None:
            nonlocal count
            if held:
                doc, item, start = np.unique(np.concatenate(held, axis=1), axis=1)
                same = verified(h, lo[doc], hi[doc], start, self.q, self.first[item], self.size[item])
                out.append(np.stack([doc, item, same])[:, same > 0])
            held.clear()
            count = 0

        for offsets, (filled, hashes, item, place) in self.tables.items():
            g = _hashes(h, offsets)
            at = np.flatnonzero(filled[g >> np.uint64(64 - _BITS)])
            at = at[at + offsets[-1] < hi[owner[at]]]  # within one text
            a, b = np.searchsorted(hashes, g[at], "left"), np.searchsorted(hashes, g[at], "right")
            at, a, b = at[b > a], a[b > a], b[b > a]
            while len(at):
                n = max(1, int(np.searchsorted(np.cumsum(b - a), PAIRS, "right")))
                many = (b - a)[:n]
                which = np.repeat(np.arange(n), many)
                k = a[:n][which] + np.arange(len(which)) - _spans(many)[0][which]
                held.append(np.stack([owner[at[:n]][which], item[k], at[:n][which] - place[k]]))
                count += len(k)
                if count >= PAIRS:
                    flush()
                at, a, b = at[n:], a[n:], b[n:]
        flush()
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        doc, item, same = np.concatenate(out, axis=1)
        return doc, item, same


_FOUND = "contaminated boolean, n_items bigint, item_ids array<bigint>, best_share double"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), text_bytes().alias("t")).distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, most: int = SEEDS) -> DataFrame:
    """Every document's overlaps with benchmark items, beside the columns in keep (default: doc_id).

    A hit is a mask's hash that an item and the document share. Around it the item is laid on the document
    without gaps; the overlap counts if in some 13 tokens in a row (all tokens of a shorter item) four
    fifths agree. The masks fit into every such overlap. Returns contaminated, n_items, item_ids (array, ascending) and
    best_share, the largest share of an item's tokens found. Null and empty texts, and items without tokens or id,
    overlap with nothing; items that share an id count once; an empty benchmark leaves all documents clean. Repeated
    documents stay; an empty table gives no rows. Columns in keep may have any name but those returned.

    A benchmark of at most `most` seeds (measured) goes to every task; a larger one is joined with the documents by the
    seeds' hashes, where documents send those that pass a filter of bounded size.
    """
    keep = ["doc_id"] if keep is None else keep
    items = _items(benchmark)
    # a token takes two bytes at least, with what parts it from the next
    size = items.agg(F.coalesce(F.sum(len(MASKS[STRETCH]) * (1 + F.floor(F.octet_length("t") / 2))), F.lit(0))).first()[0]
    return _sent(documents, items, keep) if size <= most else _joined(documents, items, keep, size)


def _fields(rows: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in names)


def _sent(documents: DataFrame, items: DataFrame, keep: list[str]) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast([(r.item_id, bytes(r.t)) for r in items.orderBy("item_id", "t").collect()])
    rows = documents.select(*keep, text_bytes().alias("_bytes"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(sent.value)
        for b in batches:
            found: list[dict[int, float]] = [{} for _ in range(len(b))]
            for d, k, same in zip(*(x.tolist() for x in seeds.overlaps(b.column("_bytes").to_pylist())), strict=True):
                i = int(seeds.ids[k])
                found[d][i] = max(found[d].get(i, 0.0), same / int(seeds.size[k]))
            cols = [pa.array([bool(f) for f in found]), pa.array([len(f) for f in found], pa.int64()), pa.array([sorted(f) for f in found], pa.list_(pa.int64())), pa.array([max(f.values(), default=0.0) for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *cols], names=[*keep, "contaminated", "n_items", "item_ids", "best_share"])

    return rows.mapInArrow(lean(compare, "_bytes"), _fields(rows, keep) + _FOUND)


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list[np.ndarray]] = [[], [], []]
        for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True):
            h = word_hashes(tokens(t))
            for offsets in _offsets(len(h)) if len(h) else ():
                g = _hashes(h, offsets)
                for c, x in zip(out, (g.view(np.int64), np.full(len(g), k), np.arange(len(g))), strict=True):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["seed", "k", "q"])


def _filter(seeds: DataFrame, count: int) -> np.ndarray:
    """A bit for each value of a seed's leading bits: at least eight for each seed up to a bound, beyond which more
    seeds of documents pass it. Parts of it are joined on the cluster."""
    bits = min(FILTER_BITS, max(20, (8 * count).bit_length()))
    chunk = 16  # bits of a part's own

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            filled[b.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        parts = np.packbits(filled).reshape(-1, 1 << (chunk - 3))
        k = np.flatnonzero(parts.any(1))
        for i in k.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([parts[i].tobytes()], pa.binary())], names=["part", "filled"])

    def union(t: pa.Table) -> pa.Table:
        got = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in t["filled"]])
        return pa.table({"part": t["part"].slice(0, 1), "filled": pa.array([got.tobytes()], pa.binary())})

    out = np.zeros((1 << (bits - chunk), 1 << (chunk - 3)), dtype=np.uint8)
    for r in seeds.select("seed").mapInArrow(mark, "part bigint, filled binary").groupBy("part").applyInArrow(union, "part bigint, filled binary").collect():
        out[r.part] = np.frombuffer(r.filled, np.uint8)
    return out.reshape(-1)


def _joined(documents: DataFrame, items: DataFrame, keep: list[str], count: int) -> DataFrame:
    spark = documents.sparkSession
    items = stored(items.withColumn("k", F.monotonically_increasing_id()), "items")
    seeds = stored(items.select("k", "t").mapInArrow(lean(_seeded, "t"), "seed bigint, k bigint, q bigint"), "seeds")
    sent = spark.sparkContext.broadcast(_filter(seeds, count))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = sent.value
        shift = np.uint64(64 - (8 * len(filled)).bit_length() + 1)
        for b in batches:
            hits, hashes = [], []
            for t in b.column("_bytes").to_pylist():
                h = word_hashes(tokens(t))
                own = []
                for offsets in _all_offsets():
                    g = _hashes(h, offsets)
                    x = g >> shift
                    at = np.flatnonzero(filled[x >> np.uint64(3)] >> (np.uint64(7) - (x & np.uint64(7))).astype(np.uint8) & 1)
                    own += [{"seed": s, "p": p} for s, p in zip(g[at].view(np.int64).tolist(), at.tolist(), strict=True)]
                hits.append(own)
                hashes.append(h.tobytes() if own else None)
            cols = [*(b.column(n) for n in keep), b.column("_row"), pa.array(hits, pa.list_(pa.struct([("seed", pa.int64()), ("p", pa.int64())]))), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "_row", "_hits", "_hashes"])

    rows = documents.select(*keep, F.monotonically_increasing_id().alias("_row"), text_bytes().alias("_bytes"))
    probed = stored(rows.mapInArrow(lean(probe, "_bytes"), _fields(rows, keep) + "_row bigint, _hits array<struct<seed: bigint, p: bigint>>, _hashes binary"), "probed")
    pairs = probed.select("_row", F.inline("_hits")).join(seeds, "seed").select("_row", "k", (F.col("p") - F.col("q")).alias("d")).distinct()
    item = items.select("k", "item_id", "t", F.octet_length("t").alias("_n"))
    # of a document's hashes (8 bytes each) only what the item can cover goes on
    from_ = F.greatest(F.col("d"), F.lit(0))
    laid = pairs.join(item, "k").join(probed.where("_hashes is not null").select("_row", "_hashes"), "_row")
    laid = laid.select("_row", "item_id", "t", F.least("d", F.lit(0)).alias("d"), F.substring("_hashes", (8 * from_ + 1).cast("int"), (8 * F.col("_n")).cast("int")).alias("part"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = [word_hashes(tokens(t)) for t in b.column("t").to_pylist()]
            h = [np.frombuffer(x, np.uint64)[: max(0, len(i) + d)] for x, i, d in zip(b.column("part").to_pylist(), q, b.column("d").to_pylist(), strict=True)]
            size, own = (np.array([len(x) for x in y], dtype=np.int64) for y in (q, h))
            (first, _), (lo, hi) = _spans(size), _spans(own)
            if not len(b):
                continue
            same = verified(np.concatenate(h), lo, hi, lo + b.column("d").to_numpy(), np.concatenate(q), first, size)
            good = pa.array(same > 0)
            yield pa.RecordBatch.from_arrays([b.column("_row").filter(good), b.column("item_id").filter(good), pa.array((same / np.maximum(size, 1))[same > 0])], names=["_row", "item_id", "share"])

    found = laid.mapInArrow(lean(verify, "part"), "_row bigint, item_id bigint, share double")
    found = found.groupBy("_row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("best_share"))
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return probed.select(*keep, "_row").join(found, "_row", "left").select(
        *keep, F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"), F.coalesce("best_share", F.lit(0.0)).alias("best_share")
    )
