"""Packing of token sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, lean, stored

LENGTH = 4096
STEP = 4  # lengths are rounded up to this for the histogram, so a combination wastes less than 3 * STEP
END_ID = 2
SLICE = 1 << 19  # bytes of texts encoded together: what is made of them stays in a processor's cache


# Characters whose normalisation, case and class don't depend on their neighbours or on a Unicode version.
_SIMPLE = "!-~\u00a1-\u012f\u0131-\u017f"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 for itself, then from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _of_category(first: str) -> str:
    """The simple characters of a general category, for a character class."""
    found = [c for c in map(chr, range(33, 0x180)) if re.match(f"[{_SIMPLE}]", c) and unicodedata.category(c).startswith(first)]
    return "".join(map(re.escape, found))


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit numbers. The tokenizer drops white space and never joins
    across it, so the ids of a text are those of its parts between blanks.

    Where the tokenizer's own description says that it lower-cases, splits by a pattern and then merges bytes, simple
    texts are split here; the pieces of a batch that aren't known yet go to the tokenizer's model together. All
    else goes through the tokenizer, part by part. When too many pieces are known, or too long ones, all are
    forgotten.
    """

    MOST = 600_000
    MOST_LETTERS = 24_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if max(self.tokenizer.get_vocab_size(), END_ID + 1) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        d = json.loads(self.tokenizer.to_str())
        self.split = self._pattern(d)
        self.simple = re.compile(f"[{_SIMPLE}]*")
        self.simple_text = re.compile(f"[{_SIMPLE} \n]*")
        self.firsts = {c for t in d["added_tokens"] for c in (t["content"][:1].lower(), t["content"][:1].upper())}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in d["added_tokens"]) or "(?!)", re.IGNORECASE)
        letters = _byte_letters()
        # simple pieces have no other bytes than printable ASCII, which stands for itself, and those from 128 on
        self.letters = np.array([b if b < 128 else ord(letters[b]) for b in range(256)], dtype="<u2")
        self.last = self._last(d, letters)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[str, bytes] = {}
        self.letters_known = 0

    @staticmethod
    def _last(d: dict, letters: dict[int, str]) -> np.ndarray | None:
        """Of each id, whether it ends a piece; None where the vocabulary doesn't tell for all bytes."""
        suffix, vocab = d["model"].get("end_of_word_suffix"), d["model"].get("vocab")
        if not suffix or not all(c in vocab and c + suffix in vocab for c in letters.values()):
            return None
        out = np.zeros(1 << 16, dtype=bool)
        out[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return out

    @staticmethod
    def _pattern(d: dict) -> re.Pattern | None:
        """The split pattern over simple characters, if the description is of the kind that is split here."""
        steps = [n.get("type") for n in (d.get("normalizer") or {}).get("normalizers", ())]
        parts = (d.get("pre_tokenizer") or {}).get("pretokenizers", ())
        if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"] or d["model"].get("dropout"):
            return None
        split, level = parts
        if split.get("behavior") != "Removed" or not split.get("invert") or level.get("add_prefix_space") or level.get("use_regex") or "Regex" not in split["pattern"]:
            return None
        pattern = split["pattern"]["Regex"].replace(r"\p{L}", _of_category("L")).replace(r"\p{N}", _of_category("N"))
        return None if r"\p" in pattern else re.compile(pattern)

    def _is_simple(self, text: str, pattern: re.Pattern) -> bool:
        return self.split is not None and bool(pattern.fullmatch(text)) and (not any(c in text for c in self.firsts) or not self.special.search(text))

    def _pieces(self, text: str) -> list[str]:
        """A text's pieces; a part that goes through the tokenizer stands as itself behind a blank."""
        if self._is_simple(text, self.simple_text):
            return self.split.findall(text.lower())
        out: list[str] = []
        for part in text.replace("\n", " ").split(" "):
            if part:
                out += self.split.findall(part.lower()) if self._is_simple(part, self.simple) else [" " + part]
        return out

    def _learn(self, new: list[str]) -> None:
        self.letters_known += sum(map(len, new))
        if len(self.known) + len(new) > self.MOST or self.letters_known > self.MOST_LETTERS:
            self.known.clear()
            self.letters_known = sum(map(len, new))
        for part in [p for p in new if p[0] == " "]:
            self.known[part] = np.array(self.tokenizer.encode(part[1:], add_special_tokens=False).ids, dtype="<u2").tobytes()
        merged = [p for p in new if p[0] != " "]
        for i in range(0, len(merged), 16384):
            block = merged[i : i + 16384]
            line = self.letters[np.frombuffer(" ".join(block).encode(), np.uint8)].tobytes().decode("utf-16-le")
            if self.last is not None:  # without places of words, which take time
                ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u2")
                ends = [0, *(2 * np.flatnonzero(self.last[ids]) + 2).tolist()]
            else:
                got = self.model.encode(line, add_special_tokens=False)
                ids = np.array(got.ids, dtype="<u2")
                ends = (2 * np.searchsorted(np.array(got.word_ids), np.arange(len(block) + 1))).tolist()
            data = ids.tobytes()
            self.known.update(zip(block, (data[a:b] for a, b in zip(ends, ends[1:], strict=False)), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        end, get = np.uint16(END_ID).tobytes(), self.known.get
        rows, open_, new = [], [], set()
        for t in texts:
            pieces = self._pieces(t)
            ids = list(map(get, pieces))
            if None in ids:
                missing = [(i, pieces[i]) for i, x in enumerate(ids) if x is None]
                new.update(p for _, p in missing)
                open_.append((ids, missing))
            ids.append(end)
            rows.append(ids)
        self._learn(list(new))
        for ids, missing in open_:
            for i, p in missing:
                ids[i] = self.known[p]
        return list(map(b"".join, rows))


_ENCODERS: dict[str, Encoder] = {}


def encoded(documents: DataFrame, keep: list[str], tokenizer: str) -> DataFrame:
    """keep, n (ids with the end) and ids of every whole text; a null text is empty."""
    rows = documents.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(tokenizer, None) or Encoder(tokenizer)
        _ENCODERS[tokenizer] = encoder
        for b in batches:
            ids = encoder(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*keep, "n", "ids"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(lean(encode, "_text", SLICE), f"{fields}n bigint, ids binary")


def combinations(histogram: np.ndarray) -> np.ndarray:
    """Rows of three classes (0: none) that sum to a full window, of classes that occur."""
    full = len(histogram) - 1
    have = np.flatnonzero(histogram[:full])
    have = have[have > 0]
    a, b = np.meshgrid(np.append(0, have), have, indexing="ij")
    c = full - a - b
    ok = (a <= b) & (b <= c)
    ok[ok] &= histogram[c[ok]] > 0
    return np.stack([a[ok], b[ok], c[ok]], 1)


def repeats(histogram: np.ndarray, combos: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares min |A x - histogram| by multiplicative updates, then whole numbers that the
    histogram can serve: x rounded down, then more of each as far as it goes, largest remainders first."""
    if not len(combos):
        return np.zeros(0, dtype=np.int64)
    h = histogram.astype(float)
    h[0] = 0
    used = lambda x: np.bincount(combos.reshape(-1), weights=np.repeat(x, 3), minlength=len(h)) * (np.arange(len(h)) > 0)
    down = lambda y: y[combos].sum(1)
    x = np.full(len(combos), h.sum() / (3 * len(combos)))
    target = down(h)
    for _ in range(rounds):
        x = x * target / np.maximum(down(used(x)), 1e-12)
    left, out = histogram.astype(np.int64).copy(), np.zeros(len(combos), dtype=np.int64)
    parts = [np.unique(c[c > 0], return_counts=True) for c in combos]
    for want in (np.floor(x), None):
        for k in np.argsort(-(x if want is not None else x - np.floor(x)), kind="stable"):
            q, times = parts[k]
            n = int((left[q] // times).min())
            n = n if want is None else min(n, int(want[k]))
            if n > 0:
                out[k] += n
                left[q] -= n * times
    return out


def slots(combos: np.ndarray, times: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: for ranges of its documents' ranks, the first rank, the first sequence, and the place in it."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    first = 0
    for combo, n in zip(combos.tolist(), times.tolist(), strict=True):
        if n:
            for place, q in enumerate(combo):
                if q:
                    by.setdefault(q, []).append((filled.get(q, 0), first, place))
                    filled[q] = filled.get(q, 0) + n
            first += n
    out = {q: tuple(np.array(x) for x in zip(*[*rows, (filled[q], -1, 0)], strict=True)) for q, rows in by.items()}
    return out


def cut(position: int, length: int, total: int, window: int) -> Iterator[tuple[int, int, int]]:
    """(sequence, offset, length) of the pieces of a run in a stream of total tokens, cut into windows; the rest
    after the last whole window is cut into powers of two, so that no sequence is padded."""
    whole = total // window
    while length:
        if position < whole * window:
            sequence, offset = divmod(position, window)
            room = window - offset
        else:
            rest, start, sequence = total - whole * window, whole * window, whole
            while True:
                size = 1 << (rest.bit_length() - 1)
                if position < start + size:
                    break
                rest, start, sequence = rest - size, start + size, sequence + 1
            offset = position - start
            room = size - offset
        n = min(room, length)
        yield sequence, offset, n
        position, length = position + n, length - n


def packed(documents: DataFrame, tokenizer: str | None = None, window: int = LENGTH, step: int = STEP, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Whole windows of a document are sequences by themselves. What remains of each is one piece if it has a place
    in a combination; the repeats of the combinations come from non-negative least squares on the histogram of
    lengths, which has window / step numbers. The remainders without a place follow each other and are cut
    where a sequence is full. Ranks and positions come from counts by input partition. A null text is empty
    and has the end id alone; a null doc_id and repeated rows are packed like any other; other columns are not
    read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = stored(encoded(documents, ["doc_id"], tokenizer).withColumn("key", F.monotonically_increasing_id()), "ids")
    top = window // step
    narrow = rows.select("key", "n", F.shiftright("key", 33).alias("part"), (F.col("n") % window).alias("r"), F.floor(F.col("n") / window).alias("full"))
    narrow = narrow.withColumn("q", F.ceil(F.col("r") / step).cast("int"))
    counts = stored(narrow.groupBy("q", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(top + 1, dtype=np.int64)
    for r in counts.groupBy("q").agg(F.sum("n").alias("n")).collect():
        histogram[r.q] = r.n
    combos = combinations(histogram)
    times = repeats(histogram, combos)
    sequences = int(times.sum())
    sent = spark.sparkContext.broadcast(slots(combos, times))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("q").orderBy("part")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("q", "part").orderBy("key"))
    ranked = narrow.withColumn("own", own).join(before, ["q", "part"]).select("key", "part", "n", "r", "full", "q", (F.col("before") + F.col("own") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, rank = b.column("q").to_numpy(), b.column("rank").to_numpy()
            sequence, at = np.full(len(q), -1, dtype=np.int64), np.zeros(len(q), dtype=np.int32)
            for c in np.unique(q):
                if int(c) in sent.value:
                    lo, first, position = sent.value[int(c)]
                    rows_ = np.flatnonzero(q == c)
                    k = np.searchsorted(lo, rank[rows_], "right") - 1
                    sequence[rows_] = np.where(first[k] >= 0, first[k] + rank[rows_] - lo[k], -1)
                    at[rows_] = position[k]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("key", "part", "n", "r", "full")), pa.array(sequence), pa.array(at)], names=["key", "part", "n", "r", "full", "sequence", "place"])

    placed = stored(ranked.mapInArrow(place, "key bigint, part bigint, n bigint, r bigint, full bigint, sequence bigint, place int"), "placed")
    rest = F.when(F.col("sequence") < 0, F.col("r")).otherwise(0)
    sums = stored(placed.groupBy("part").agg(F.sum(rest).alias("rest"), F.sum("full").alias("whole")), "sums")
    total = sums.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each input partition
    offsets = sums.select("part", F.coalesce(F.sum("rest").over(over), F.lit(0)).alias("rest0"), F.coalesce(F.sum("whole").over(over), F.lit(0)).alias("whole0"))
    inner = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("rest1", F.coalesce(F.sum(rest).over(inner), F.lit(0))).withColumn("whole1", F.coalesce(F.sum("full").over(inner), F.lit(0)))
    offset = F.coalesce(F.sum("r").over(Window.partitionBy("sequence", F.when(F.col("sequence") < 0, F.col("key"))).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = running.join(offsets, "part").select(
        "key", "n", "r", "full", "sequence", offset.alias("offset"), (F.col("rest0") + F.col("rest1")).alias("position"), (F.col("whole0") + F.col("whole1")).alias("whole")
    )
    tail = -(-total // window) + 12  # sequences that the stream may take

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):
                out = [[] for _ in range(8)]
                for r in b.slice(at, 512).to_pylist():
                    ids, n = np.frombuffer(r["ids"], "<u2").astype("<u4"), r["n"]
                    cuts = [(k * window, window, sequences + tail + r["whole"] + k, 0) for k in range(r["full"])]
                    start = r["full"] * window
                    if r["r"] and r["sequence"] >= 0:
                        cuts.append((start, r["r"], r["sequence"], r["offset"]))
                    elif r["r"]:
                        for sequence, offset, length in cut(r["position"], r["r"], total, window):
                            cuts.append((start, length, sequences + sequence, offset))
                            start += length
                    for start, length, sequence, offset in cuts:
                        own = ids[start : start + length].tobytes()
                        for c, x in zip(out, (r["doc_id"], start, length, zlib.crc32(own), n, sequence, offset, own if keep_ids else None), strict=True):
                            c.append(x)
                types = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    out = rows.select("key", "doc_id", "ids").join(plan, "key").mapInArrow(lean(pieces, "ids"), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return out if keep_ids else out.drop("ids")
