"""Removal of repeated byte strings by longest-previous-factor arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, lean, mixed, stored, text_bytes

LENGTH = 100
GRAM = 20  # bytes of an anchor
PIECE = 1 << 20  # bytes of a document looked at together
HOT = 20_000  # differing contexts of an anchor from which its windows are compared by hash
TASK_BYTES = 1 << 20
SYMBOLS = 7  # of 9 bits (a byte and one, or an end) in a 64-bit key
_LAST = 2**63 - 1  # order of a null id
_POS = np.uint64((1 << 24) - 1)

_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed=4) for i in range(256)], dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_MASK = 0xFFFFFFFFFFFFFFFF


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(PIECE + LENGTH + 1, _BASE)
_INV = _powers(PIECE + LENGTH + 1, pow(_BASE, -1, 1 << 64))


def _prefix(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial hash: what lies between two places hashes to their difference, scaled back."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _POW[: len(data)], out=out[1:])
    return out


def _between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[start]) * _INV[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For the windows of length bytes, in order: anchor hash, anchor position, first and last window start, and
    the hash of all bytes of these windows with the anchor's place in them.

    A window's anchor is its gram with the least hash, the leftmost of equals. It depends on the window's bytes
    alone, so equal windows have equal anchors at equal places. Neighbouring windows share anchors.
    """
    prefix = _prefix(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    h = _between(prefix, at, at + gram)
    key = (h & ~_POS) | at.astype(np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    pos = (key & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    last = np.append(first[1:], len(pos)) - 1
    pos = pos[first]
    seg = _between(prefix, first, last + length) + mixed((pos - first).astype(np.uint64) * np.uint64(_BASE) + (last - first).astype(np.uint64))
    return h[pos], pos, first, last, seg


def pieces(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """A document in pieces that share length - 1 bytes, so that every window lies in exactly one."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, max(0, len(data) - length + 1), PIECE):
        yield start, data[start : start + PIECE + length - 1]


def _joined(spans: np.ndarray) -> np.ndarray:
    """Sorted, with overlapping and touching ones merged; rows are (start, end)."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    high = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > high[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], high[np.append(first[1:], len(spans)) - 1]], 1)


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    out = np.empty(len(key), dtype=np.int32)
    out[order] = np.cumsum(np.concatenate([[0], key[order[1:]] != key[order[:-1]]]))
    return out


def suffix_ranks(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of the suffixes by their first symbols, by prefix doubling: (symbols, ranks) from SYMBOLS up to at least
    depth, or until all differ. Places behind the text hold symbol 0."""
    n, key = len(text), np.zeros(len(text), dtype=np.uint64)
    for i in range(SYMBOLS):
        key <<= np.uint64(9)
        key[: max(0, n - i)] |= text[i:].astype(np.uint64)
    width, rank = SYMBOLS, _ranked(key)
    out = [(width, rank)]
    while width < depth and rank.max(initial=0) < n - 1:
        key = (rank.astype(np.int64) + 1) << 32
        key[: max(0, n - width)] |= rank[width:] + 1
        width, rank = 2 * width, _ranked(key)
        out.append((width, rank))
    return out


def common_lengths(text: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b share: whole strides by their ranks, then symbol by symbol."""
    n, out = len(text), np.zeros(len(a), dtype=np.int64)
    strides = [*reversed(ranks), *[(1, text)] * (SYMBOLS - 1)]
    for k, (width, rank) in enumerate(strides):
        again = True
        while again:
            i, j = a + out, b + out
            same = np.flatnonzero((i < n) & (j < n))
            same = same[rank[i[same]] == rank[j[same]]]
            out[same] = np.minimum(out[same] + width, n - np.maximum(a[same], b[same]))
            again = k == 0 and len(same) > 0  # only the widest stride can fit more than once
    return out


def smaller_before(pos: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix order the nearest one before it with a smaller position (-1: none), and the least
    common length up to there. lcp: with the place before. All places follow the pointers of those that they point to."""
    to, low = np.arange(len(pos)) - 1, lcp.copy()
    open_ = np.flatnonzero(to >= 0)
    while len(open_):
        open_ = open_[pos[to[open_]] > pos[open_]]
        via = to[open_]
        low[open_] = np.minimum(low[open_], low[via])
        to[open_] = to[via]
        open_ = open_[to[open_] >= 0]
    low[to < 0] = 0
    return to, low


def previous_factors(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array at the starts (ascending): how many symbols from there, up to its end, also
    occur from an earlier start. text: bytes and one, with 0 behind each part.

    In suffix order the earlier suffixes that share most are the nearest ones, before and after, with smaller positions.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    ranks = suffix_ranks(text, int((ends - starts).max()) + 1)
    order = np.lexsort((starts, ranks[-1][1][starts]))
    pos = starts[order]
    lcp = np.concatenate([[0], common_lengths(text, ranks, pos[:-1], pos[1:])])
    before = smaller_before(pos, lcp)[1]
    after = smaller_before(pos[::-1], np.concatenate([[0], lcp[:0:-1]]))[1][::-1]
    out = np.empty(len(starts), dtype=np.int64)
    out[order] = np.maximum(before, after)
    return np.minimum(out, ends - starts)


_CONTEXTS = "h bigint, seg bigint, ord bigint, th bigint, first bigint, n bigint"  # n: windows; negative where known to repeat


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of a task's documents. Of a slice only the first of equal contexts goes on; the windows of
    the others are known to repeat, so a passage that many documents share leaves few rows."""
    for b in batches:
        order, th = b.column("ord").to_numpy(), b.column("th").to_numpy()
        text, seen = b.column("b"), set()
        held: list[tuple] = []

        def out(held=held) -> pa.RecordBatch:
            h, first, last, seg = (np.concatenate(x) for x in zip(*(r[2:] for r in held), strict=True))
            o, t = (np.repeat(np.array([r[i] for r in held], dtype=np.int64), [len(r[2]) for r in held]) for i in (0, 1))
            held.clear()
            one = np.argsort(h ^ mixed(seg), kind="stable")  # of equal ones the first in order comes first
            new = np.ones(len(h), dtype=bool)
            new[one[1:]] = (h[one[1:]] != h[one[:-1]]) | (seg[one[1:]] != seg[one[:-1]])
            cols = [[h[new], seg[new], o[new], t[new], first[new], last[new] - first[new] + 1]]
            again = np.flatnonzero(~new)
            cuts = np.flatnonzero((o[again][1:] != o[again][:-1]) | (t[again][1:] != t[again][:-1])) + 1
            for k in np.split(again, cuts) if len(again) else ():
                spans = _joined(np.stack([first[k], last[k] + LENGTH], 1))
                n = len(spans)
                place = mixed(spans[:, 0].astype(np.uint64) + np.uint64(int(t[k[0]]) & _MASK))
                cols.append([place, np.zeros(n, np.uint64), np.full(n, o[k[0]]), np.full(n, t[k[0]]), spans[:, 0], spans[:, 0] + LENGTH - 1 - spans[:, 1]])
            whole = [np.concatenate(c) for c in zip(*cols, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in whole], names=["h", "seg", "ord", "th", "first", "n"])

        size = 0
        for i in np.lexsort((th, order)):
            key = (int(order[i]), int(th[i]))
            if key in seen:  # a repeated row is the same document
                continue
            seen.add(key)
            for start, data in pieces(text[int(i)].as_py()):
                h, _, first, last, seg = anchors(data)
                held.append((*key, h, first + start, last + start, seg))
                size += len(h)
                if size > 300_000:
                    yield out()
                    size = 0
        if held:
            yield out()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts to compare; of hot anchors the hash of each window instead."""
    for b in batches:
        out: dict[str, list] = {n: [] for n in ("h", "ord", "th", "start", "bytes", "window")}
        for i in range(len(b)):
            text = b.column("b")[i].as_py()
            o, t = b.column("ord")[i].as_py(), b.column("th")[i].as_py()
            for s in b.column("open")[i].as_py():
                data = text[s["first"] : s["first"] + s["n"] - 1 + LENGTH]
                if s["hot"]:
                    windows = [xxhash.xxh3_128_digest(data[k : k + LENGTH]) for k in range(len(data) - LENGTH + 1)]
                    rows = [(None, s["first"] + k, None, w) for k, w in enumerate(windows)]
                else:
                    rows = [(s["h"], s["first"], data, None)]
                for h, start, part, window in rows:
                    for n, x in zip(out, (h, o, t, start, part, window), strict=True):
                        out[n].append(x)
        types = [pa.int64()] * 4 + [pa.binary()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), types, strict=True)], names=list(out))


def _factored(t: pa.Table) -> pa.Table:
    """Repeats among the contexts of a task: they follow each other in the documents' order, and the
    longest-previous-factor array tells which windows repeat an earlier one. No window crosses two contexts."""
    o, th, start = (t.column(n).to_numpy() for n in ("ord", "th", "start"))
    order = np.lexsort((start, th, o))
    # repeated rows of a document give the same context once more
    order = order[np.concatenate([[True], (np.diff(o[order]) != 0) | (np.diff(th[order]) != 0) | (np.diff(start[order]) != 0)])]
    parts = [t.column("bytes")[int(i)].as_py() for i in order]
    size = np.array([len(p) for p in parts])
    end = np.cumsum(size + 1) - 1
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.uint16) + 1
    text[end] = 0
    runs = size - LENGTH + 1
    owner = np.repeat(np.arange(len(parts)), runs)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    again = previous_factors(text, (end - size)[owner] + within, end[owner]) >= LENGTH
    own, at = owner[again], within[again]
    o, th, lo = o[order][own], th[order][own], start[order][own] + at
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])) if len(own) else np.zeros(0, np.int64)
    hi = lo[np.append(new[1:], len(own)) - 1] + LENGTH if len(own) else lo
    return pa.table({"ord": pa.array(o[new], pa.int64()), "th": pa.array(th[new], pa.int64()), "lo": pa.array(lo[new], pa.int64()), "hi": pa.array(hi, pa.int64())})


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [[] for _ in range(4)]
        kept = []
        for text, spans in zip(b.column("b").to_pylist(), b.column("spans").to_pylist(), strict=True):
            cut = _joined(np.array([(s["lo"], s["hi"]) for s in spans or ()], dtype=np.int64).reshape(-1, 2))
            parts, end = [], 0
            for lo, hi in cut.tolist():
                parts.append(text[end:lo])
                end = hi
            rest = b"".join([*parts, text[end:]])
            for c, x in zip(out, (len(text), len(text) - len(rest), len(cut), hashlib.sha256(rest).hexdigest()), strict=True):
                c.append(x)
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(out)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _order(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(_LAST))


def repeats_removed(documents: DataFrame, hot: int = HOT, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (and kept, its remaining bytes).

    A byte goes if it lies in a 100-byte string that also starts earlier. Documents come in the order of their
    id, a null id last; rows that share an id come in the order of their text's hash, and rows that share id and
    text are one document, each row with its result. Windows meet by their anchor; all windows of one anchor are a
    context. Equal contexts (by 128 bits of hashes) are one text, its first occurrence: the others repeat it as a whole.
    Contexts that differ but share an anchor go to a task of bounded size, where the longest-previous-factor array
    of all their suffixes tells which windows repeat an earlier one. Of an anchor with more than `hot` differing
    contexts each window is a context by itself, so that no anchor's rows need to meet in one task. A null text is
    empty. Other columns are not read; an empty table gives no rows.
    """
    docs = documents.select("doc_id", _order().alias("ord"), text_bytes().alias("b")).withColumn("th", F.xxhash64("b"))
    rows = docs.select("ord", "th", "b").mapInArrow(lean(_anchored, "b"), _CONTEXTS)
    # copies of one row never differ in order: the least of (ord, th, first) is the first occurrence. A slice sends a context once
    rank = F.dense_rank().over(Window.partitionBy("h", "seg").orderBy("ord", "th", "first"))
    ranked = stored(rows.withColumn("again", (F.col("n") < 0) | (rank > 1)).select("h", "ord", "th", "first", F.abs("n").alias("n"), "again"), "contexts")
    again = ranked.where("again").select("ord", "th", F.col("first").alias("lo"), (F.col("first") + F.col("n") - 1 + LENGTH).alias("hi"))
    own = ranked.where("not again").drop("again")
    # a row that stands twice has its contexts twice, which costs a comparison but changes nothing
    shared = own.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select("h", (F.col("contexts") > hot).alias("hot"))
    opened = own.join(shared, "h").groupBy("ord", "th").agg(F.collect_set(F.struct("h", "first", "n", "hot")).alias("open"))
    contexts = stored(docs.select("ord", "th", "b").join(opened, ["ord", "th"]).mapInArrow(lean(_opened, "b"), "h bigint, ord bigint, th bigint, start bigint, bytes binary, window binary"), "opened")
    total = contexts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    tasks = total // TASK_BYTES + 1
    cold = contexts.where("window is null").withColumn("task", F.pmod(F.xxhash64("h"), F.lit(tasks)))
    found = cold.groupBy("task").applyInArrow(_factored, "ord bigint, th bigint, lo bigint, hi bigint")
    windows = contexts.where("window is not null").select("window", "ord", "th", "start")
    first = windows.groupBy("window").agg(F.min(F.struct("ord", "th", "start")).alias("least"))
    late = windows.join(first, "window").where(F.struct("ord", "th", "start") > F.col("least")).select("ord", "th", F.col("start").alias("lo"), (F.col("start") + LENGTH).alias("hi"))
    # neighbouring windows are one span before they are shuffled by document
    late = late.withColumn("run", F.col("lo") - F.row_number().over(Window.partitionBy("ord", "th").orderBy("lo"))).groupBy("ord", "th", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")
    spans = again.unionByName(found).unionByName(late).groupBy("ord", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = stored(spans, "spans")
    for t in (ranked, contexts):
        dropped(t)
    out = docs.join(spans, ["ord", "th"], "left").select("doc_id", "b", "spans")
    out = out.mapInArrow(lean(_removed, "b"), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")
