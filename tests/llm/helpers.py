"""Small fixtures with every odd case, and brute-force versions."""

import random
import zlib

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPLIT = " \t\n\x0b\x0c\r"


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def words(text):
    out, word = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if c in SPLIT:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def prose(rng, n, vocabulary=None):
    vocabulary = vocabulary or ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def odd_documents(seed=7, n=60):
    """Nulls in every column, empty, blank and long texts, exact and near copies, repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(1, 120))
        rows.append((i, text, rng.choice(["en", "de", None]), "s", len(text)))
    base = rows[5][1] + " " + prose(rng, 80)
    for i in range(n, n + 12):
        w = base.split(" ")
        for _ in range(i - n):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(n + 20, base, "en", None, None), (n + 21, base.upper(), "en", "s", 1), (n + 22, None, None, None, None), (n + 23, "", "en", "s", 0), (n + 24, " \n\t ", "en", "s", 4)]
    rows += [(n + 25, "Ein Wort", "de", "s", 8), (n + 26, "été ßtraße 漢字 \U0001f600 " * 30, "fr", "s", 9), (n + 27, prose(rng, 6000), "en", "s", 1), (n + 28, "the " * 900, "en", "s", 1)]
    rows += [rows[3], rows[3], (None, "a text without id " * 3, "en", "s", 3)]
    return rows


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
