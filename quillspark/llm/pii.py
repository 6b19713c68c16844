"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

KINDS = ("email", "ip", "card", "phone")
LEAST = 0.5  # probability from which a candidate becomes a span

# The base patterns; what they mean is fixed by the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails at its start fails at each later digit, so that matches begin where runs do.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|\bat\b|\(at\)|\[at\]", re.ASCII)

# Candidates beyond the base: written-out addresses, numbers without a plus, longer addresses, grouped numbers.
_LOOSE = (
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}"),
    re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    re.compile(r"(?<![0-9-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9-])"),
    re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])|(?<![0-9])00[1-9][0-9]{0,2}(?:[ -][0-9]{2,4}){2,5}(?![0-9-])"),
)

# Gazetteers: endings of addresses, first digits of card numbers, country codes.
ENDINGS = frozenset("com org net edu gov int info io co uk de fr es it eu us ca au ch at nl be".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "6011", "65", "35", "62")
COUNTRY = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
# Words of the context, before a span.
NEAR = (
    ("email", "e-mail", "mail", "contact", "write"),
    ("ip", "host", "server", "address", "ping", "client"),
    ("card", "visa", "mastercard", "amex", "payment", "credit"),
    ("phone", "tel", "call", "mobile", "cell", "fax", "dial"),
)
AGAINST = ("version", "isbn", "order", "invoice", "section", "serial", "ticket", "release", "chapter")

VOTERS = 5
SHAPES = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What a left-to-right search finds, in linear time: before each @ the run of its characters, after it a domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and non-overlapping within a kind; failing matches go."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and wider candidates that overlap none of them."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more = []
    for kind, pattern in enumerate(_LOOSE):
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                more.append((kind, m.start(), m.end()))
                taken.append((m.start(), m.end()))
    return base, sorted(more)


def _code(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """The labelers' votes (0 no, 1 abstains, 2 yes) and the span's shape, as one number."""
    s = text[start:end]
    d = _digits(s)
    before = text[max(0, start - 32) : start].lower()
    words = set(re.findall(r"[a-z-]+", before))
    if kind == 0:
        form = 2 if len(s) >= 6 and not s.startswith(".") else 0
        listed = 2 if re.split(r"[^A-Za-z0-9]+", s.lower())[-1] in ENDINGS else 0
    elif kind == 1:
        form = 2 if ":" in s or all(p == "0" or not p.startswith("0") for p in s.split(".")) else 0
        listed = 1 if ":" in s else 0 if s.startswith(("0.", "255.")) else 2
    elif kind == 2:
        form = 2 if luhn(d) else 0
        listed = 2 if d.startswith(ISSUERS) else 0
    else:
        form = 2 if 10 <= len(d) <= 14 else 0
        plain = d[2:] if d.startswith("00") else d
        listed = (2 if plain.startswith(COUNTRY) else 0) if s.startswith(("+", "00")) else 1
    pattern = 2 if base else 1
    near = 0 if words & set(AGAINST) else 2 if words & set(NEAR[kind]) else 1
    left, right = text[start - 1 : start], text[end : end + 1]
    alone = 0 if left.isalnum() or right.isalnum() else 2
    votes = (pattern, form, listed, near, alone)
    shape = min(5, len(s) // 6) * 4 + (" " in s) * 2 + ("-" in s)
    out = kind
    for v in votes:
        out = out * 3 + v
    return out * SHAPES + shape


def decoded(code: int) -> tuple[int, list[int], int]:
    rest, shape = divmod(code, SHAPES)
    votes = []
    for _ in range(VOTERS):
        rest, v = divmod(rest, 3)
        votes.append(v)
    return rest, votes[::-1], shape


@dataclass
class Model:
    """Probability of a span by its code, and the labelers' estimated reliabilities by kind."""

    weights: np.ndarray
    reliability: dict[str, list[list[float]]]

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(codes) @ self.weights, -30, 30)))


def _design(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), len(KINDS) + len(KINDS) * VOTERS * 3 + SHAPES))
    for i, c in enumerate(codes):
        kind, votes, shape = decoded(int(c))
        out[i, kind] = 1
        for j, v in enumerate(votes):
            out[i, len(KINDS) + (kind * VOTERS + j) * 3 + v] = 1
        out[i, -SHAPES + shape] = 1
    return out


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> Model:
    """EM over the votes' patterns (by kind: each labeler's votes depend only on whether the span is real),
    then logistic regression on votes and shape against EM's probabilities, weighted by counts."""
    got = [decoded(int(c)) for c in codes]
    kind = np.array([g[0] for g in got], dtype=int)
    votes = np.array([g[1] for g in got], dtype=int).reshape(-1, VOTERS)
    soft, reliability = np.zeros(len(codes)), {}
    for k, name in enumerate(KINDS):
        at = np.flatnonzero(kind == k)
        if not len(at):
            continue
        v, n = votes[at], counts[at].astype(float)
        p = np.clip(0.5 + 0.15 * (v - 1).sum(1), 0.05, 0.95)  # majority to begin with
        for _ in range(rounds):
            share = ((p * n).sum() + 1) / (n.sum() + 2)
            tables = []
            for y in (p, 1 - p):
                # a labeler is trusted a little beforehand: no vote is impossible, agreement is likelier
                prior = np.array([1.0, 2.0, 4.0] if y is p else [4.0, 2.0, 1.0])
                t = np.array([[(y * n)[v[:, j] == x].sum() for x in range(3)] for j in range(VOTERS)]) + prior
                tables.append(t / t.sum(1, keepdims=True))
            logs = [np.log(t)[np.arange(VOTERS), v].sum(1) for t in tables]
            p = 1 / (1 + np.exp(np.clip(logs[1] - logs[0] + np.log((1 - share) / share), -30, 30)))
        soft[at] = p
        reliability[name] = [[float(t[j, 2]) for j in range(VOTERS)] for t in tables]
    x, w = _design(codes), np.zeros(len(KINDS) + len(KINDS) * VOTERS * 3 + SHAPES)
    n = counts / max(1, counts.sum())
    for _ in range(500):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - 2.0 * (x.T @ (n * (q - soft)) + 1e-4 * w)
    return Model(w, reliability)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def extracted(documents: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and spans: an array of struct(kind, start, end, base, code) of every document's whole text."""
    rows = documents.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("code", pa.int64())]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("_text").to_pylist():
                base, more = candidates(t)
                out.append([{"kind": k, "start": a, "end": e, "base": x, "code": _code(t, k, a, e, x)} for x, spans in ((True, base), (False, more)) for k, a, e in spans])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(out, kind)], names=[*keep, "spans"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(lean(extract, "_text"), f"{fields}spans array<struct<kind: int, start: bigint, end: bigint, base: boolean, code: bigint>>")


def trained(spans: DataFrame) -> Model:
    """From the counts of all candidates' codes in all documents; there are at most 4 * 3^5 * SHAPES codes."""
    got = spans.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    return fit(np.array([r.code for r in got], dtype=np.int64), np.array([r.n for r in got], dtype=float))


def chosen(model: Model) -> list[int]:
    """The codes whose candidates become spans; base spans do so whatever their code."""
    every = np.arange(len(KINDS) * 3**VOTERS * SHAPES)
    every = every[[decoded(int(c))[1][0] != 2 for c in every]]
    return [int(c) for c in every[model.probability(every) >= LEAST]]


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added).

    Offsets are code points, ends exclusive. A null text is empty; a text without spans has empty lists and the
    hash of the empty string. Repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    rows = stored(extracted(documents, ["doc_id"]), "spans")
    sent = documents.sparkSession.sparkContext.broadcast(frozenset(chosen(trained(rows))))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(6)]
            for spans in b.column("spans").to_pylist():
                base = [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]]
                every = base + [(s["kind"], s["start"], s["end"]) for s in spans if not s["base"] and s["code"] in sent.value]
                for k in range(4):
                    out[k].append(sum(s[0] == k for s in base))
                out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[5].append(joined(every))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return rows.mapInArrow(lean(report, None), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def _redacted(text: str, spans: list[dict], codes: frozenset[int]) -> str:
    parts, end = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
        if s["base"] or s["code"] in codes:
            if s["start"] >= end:
                parts += [text[end : s["start"]], f"<{KINDS[s['kind']]}>"]
            end = max(end, s["end"])
    return "".join([*parts, text[end:]])


def redacted(documents: DataFrame) -> DataFrame:
    """documents with every span of the text replaced by its kind in angle brackets; overlaps are one span of
    the first's kind. n_chars, where there is one, follows the text. A null text stays null, an empty one empty;
    repeated rows stay; columns may have any name; an empty table gives no rows. Spans are found once and kept beside
    the rows, as the model needs those of all documents before any is replaced."""
    found = stored(extracted(documents.select(F.struct(*documents.columns).alias("_row"), "text"), ["_row"]), "private")
    sent = documents.sparkSession.sparkContext.broadcast(frozenset(chosen(trained(found))))
    names = documents.columns
    at = [n.lower() for n in names].index("text")

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # rows without spans are as they were
            some = np.flatnonzero(pc.list_value_length(b.column("spans")).to_numpy(zero_copy_only=False) > 0)
            row = b.column("_row")
            cols = [row.field(i) for i in range(len(names))]
            if len(some):
                texts, own = cols[at].to_pylist(), b.column("spans").take(pa.array(some)).to_pylist()
                for i, spans in zip(some.tolist(), own, strict=True):
                    texts[i] = _redacted(texts[i], spans, sent.value)
                cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = found.mapInArrow(lean(redact, None), documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out
