import functools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm import packing as P

from .helpers import DOCS, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("window", [4096, 256])
def test_round_trip(spark, window):
    rows = odd_documents() + [(900, "a<|endoftext|>b it's don 't x\tÉ é    ΑΣ 12a", "", "", 0)]
    got = P.packed(spark.createDataFrame(rows, DOCS).repartition(3), PATH, window=window, keep_ids=True).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        by[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        seq[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(plain(t))
    for i, texts in want.items():
        whole = sorted(x for t in texts for x in [t]) if len(texts) > 1 else None
        if whole is None:
            ids = [x for _, p, _ in sorted(by[i], key=lambda p: p[0]) for x in p]
            assert ids == texts[0] and all(n == len(ids) for *_, n in by[i])
        else:
            assert sum(len(p) for _, p, _ in by[i]) == sum(map(len, texts))
    padding = total = 0
    for parts in seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        total += end
        padding += 0 if end & (end - 1) == 0 else window - end
    assert padding <= 0.01 * total


def test_encoder_is_the_tokenizer(monkeypatch):
    import random

    monkeypatch.setattr(P.Encoder, "MOST", 40)
    rng = random.Random(9)
    letters = "abcXYZ0189.,;:!?'$%&*<>|@#-_/ \n\t\r\x0b\x1c\x85\u00a0éÉßÄñçœŒŁİıſǅΣςσΑ漢字😀\u0301\u200bµªº²½\u00ad"
    texts = ["it's I'LL we've 'S <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "", " ", "\n\n"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    encoder = P.Encoder(PATH)
    assert encoder.split is not None
    for t, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == plain(t), repr(t)


def test_repeats_serve_the_histogram():
    rng = np.random.default_rng(0)
    h = np.bincount(rng.integers(1, 64, 5000), minlength=65)
    c = P.combinations(h)
    assert (c.sum(1) == 64).all()
    n = P.repeats(h, c)
    used = np.bincount(c.reshape(-1), weights=np.repeat(n, 3), minlength=65)[1:]
    assert (used <= h[1:]).all() and used.sum() > 0.9 * h.sum()


def test_empty(spark):
    assert P.packed(spark.createDataFrame([], DOCS), PATH).collect() == []
