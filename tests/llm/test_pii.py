import hashlib
import random
import re

from quillspark.llm import pii as P

from .helpers import DOCS, odd_documents, prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def texts():
    rng = random.Random(5)
    pieces = ["a.b@c.de", "@", "x@y", "x@y.z@w.v.u", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.0004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+49 30 123456789 0123456789"]
    pieces += ["+", "12", "a@b..c", "é@é.fr", "..@a.b", "joe at example dot com", "call 555-123-4567", "4222222222222", "0" * 25, "1..2.3.4", "-@-.-", "fe80:0:0:0:1:2:3:4"]
    for _ in range(3000):
        yield rng.choice(["", " ", "\n"]).join(rng.choice([*pieces, prose(rng, 2)]) for _ in range(rng.randint(1, 8)))


def test_base_spans_are_the_patterns():
    for t in texts():
        assert P.base_spans(t) == brute(t), t


def test_linear_on_long_runs():
    for t in ("1" * 300_000, "a" * 300_000, "1.2." * 100_000, "a@" * 100_000, "+1" + " " * 300_000):
        P.candidates(t)


def test_query(spark):
    rows = odd_documents() + [(1000 + i, t, None, None, None) for i, t in enumerate(texts()) if i < 300]
    got = P.personal_data(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {r[0]: r[1] or "" for r in rows}
    added = 0
    for r in got:
        base = brute(by[r.doc_id])
        own = P.joined(base)
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        spans = r.spans.split(",") if r.spans else []
        assert set(own.split(",") if own else []) <= set(spans)
        added += len(spans) - len(base)
    assert added > 0
    assert P.personal_data(spark.createDataFrame([], DOCS)).collect() == []


def test_redacted(spark):
    rows = [(1, "write to joe@x.com or +1 (988) 555-2485.", "en", "s", 3), (2, None, None, None, None), (3, "clean", "en", "s", 5)]
    got = {r.doc_id: (r.text, r.n_chars) for r in P.redacted(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: ("write to <email> or <phone>.", 28), 2: (None, None), 3: ("clean", 5)}
