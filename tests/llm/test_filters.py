"""Language ID, quality, decontamination, sharding."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontaminate as D
from quillspark.llm import langid, quality, sharding

from .helpers import DOCS, crc, odd_documents, prose


def languages(n=400):
    rng = random.Random(6)
    letters = {"aa": "abcde ", "bb": "fghijk ", "cc": "éàüñ ç"}
    out = []
    for i in range(n):
        lang = rng.choice(list(letters))
        out.append((i, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(20, 900))), lang, "s", 0))
    return out + [(n + 1, None, "aa", "", 0), (n + 2, "123 !?", "aa", "", 0), (n + 3, "", None, "", 0), (n + 4, "漢字", None, None, None), out[0]]


def test_language(spark):
    rows = languages()
    df = spark.createDataFrame(rows, DOCS)
    got = langid.predicted_language(df, langid.train(df)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:400]}
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if 401 <= r.doc_id <= 403} == {401: "und", 402: "und", 403: "und"}
    empty = df.limit(0)
    assert langid.predicted_language(empty, langid.train(empty)).collect() == []
    assert {r.lang_pred for r in langid.predicted_language(df, langid.train(empty)).collect()} == {"und"}


def test_windows_cover_every_run():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 300, 509, 510, 2000):
        text = rng.integers(1, 256, n).astype(np.uint8).tobytes()
        w = [x.tobytes() for x in langid.windows(text)]
        assert b"".join([w[0], *(x[langid.WINDOW - langid.STRIDE :] for x in w[1:])]).rstrip(b"\0") == text
        assert all(any(text[i : i + 4] in x for x in w) for i in range(n - 3))


def test_language_of_many_languages(spark):
    """No language is left out, however many there are and however long one text is."""
    rng = random.Random(7)
    names = [f"l{k}" for k in range(30)]
    letters = {n: rng.sample([chr(c) for c in range(0x430, 0x450)] + list("abcdefghijklmnopqrstuvwxyz"), 6) for n in names}
    rows = [(i, "".join(rng.choice(letters[names[i % 30]]) for _ in range(3000 if i == 4 else 150)), names[i % 30], "s", 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df, 60_000)
    assert sorted(model["names"]) == sorted(names)
    held = [r for r in langid.predicted_language(df, model).collect() if r.held_out]
    assert np.mean([r.lang_pred == names[r.doc_id % 30] for r in held]) > 0.7  # of 30


TABLES = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@there
def test_language_of_the_tables(spark):
    docs = spark.read.parquet(TABLES + "/documents.parquet")
    held = langid.predicted_language(docs, langid.train(docs)).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held if r.lang_pred != "und"]) > 0.97


@there
def test_quality_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{n}.parquet") for n in ("documents", "labels"))
    held = quality.quality_scores(docs, quality.train(docs, labels)).where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.93
    good, bad = ([r.score for r in held if r.quality == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.93


def test_quality_fit_is_bounded_and_stable(spark):
    """A key with many rows counts once; the model doesn't depend on partitions."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 40) if i % 3 else "$ " * 30, None, None, 0) for i in range(200)] + [(1, prose(rng, 30), None, None, 0) for _ in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] * 2, "doc_id bigint, quality int, toxic int")
    one, other = (quality.train(df.repartition(n), lab, labelled=50) for n in (1, 5))
    assert all(np.array_equal(one[k], other[k]) for k in one)
    assert np.array_equal(quality.train(df, lab, labelled=50)["w"], one["w"])


def test_network_equals_its_tables():
    rng = np.random.default_rng(0)
    p = {"e": rng.normal(size=(256, langid.EMBED)), "o": rng.normal(size=(36, 2)), "c": np.zeros(2)}
    for w in langid.WIDTHS:
        p |= {f"w{w}": rng.normal(size=(w * langid.EMBED, langid.FILTERS)), f"b{w}": rng.normal(size=langid.FILTERS)}
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    plain = []
    for w in langid.WIDTHS:
        z = np.stack([p["e"][x[:, i : i + w]].reshape(3, -1) @ p[f"w{w}"] + p[f"b{w}"] for i in range(langid.WINDOW - w + 1)], 1)
        plain.append(np.maximum(z.max(1), 0))
    assert np.allclose(langid.Predictor(langid.compiled(p, ["a", "b"]))._pooled(x), np.hstack(plain), atol=1e-3)


def test_quality(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        good = rng.random() < 0.8
        rows.append((i, prose(rng, 80) if good else prose(rng, 3) * 30 + " $$$ !!", "en", "s", 0))
        labels.append((i, int(good), 0))
    odd = [(1000 + k, *r[1:]) for k, r in enumerate(odd_documents())]
    df = spark.createDataFrame(rows + odd, DOCS)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5, None, None), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.quality_scores(df, quality.train(df, lab)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(x[:2] for x in labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.quality_scores(df.limit(0), quality.train(df.limit(0), lab)).collect() == []


def overlaps(text, item):
    """All diagonals: some stretch of 13 tokens (all of a shorter item) agrees in four fifths. Knows nothing of masks."""
    t, q = D.tokens((text or "").encode()), D.tokens((item or "").encode())
    need = min(13, len(q))
    for d in range(-len(q) + 1, len(t)):
        same = [0 <= d + i < len(t) and t[d + i] == q[i] for i in range(len(q))]
        for k in range(max(0, -d), min(len(q), len(t) - d) - need + 1):
            if need and 5 * sum(same[k : k + need]) >= 4 * need:
                return True
    return False


def test_masks_fit_every_pattern():
    """Whatever tokens are replaced, as many as four fifths leave, some mask fits between them."""
    for n, masks in D.MASKS.items():
        for out in itertools.combinations(range(n), n - -(-4 * n // 5)):
            assert any(all(m[i] == "0" or s + i not in out for i in range(len(m))) for m in masks for s in range(n - len(m) + 1))


def test_decontaminate_brute_force(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 20, 30, 40, 40, 60])]
    items += [(90, None), (91, ""), (None, "x y z"), (3, prose(rng, 20)), (92, items[8][1])]
    rows = odd_documents()[:40]
    for i in range(500, 800):
        w = items[i % 20][1].split(" ")
        for _ in range(rng.randint(0, max(1, len(w) // 4))):
            w[rng.randrange(len(w))] = "other"
        rows.append((i, prose(rng, rng.choice([0, 0, 5, 40])) + " " + " ".join(w[rng.choice([0, 0, 2, 5]) :]).upper() + ", " + prose(rng, rng.choice([0, 5])), "en", "s", 0))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    key = lambda r: (r[0] if r[0] is not None else -1, r[1])
    want = sorted(((i, sorted({k for k, q in items if k is not None and q and overlaps(t, q)})) for i, t, *_ in rows), key=key)
    both = []
    for most in (D.SEEDS, 10):
        got = D.contaminated(docs, bench, most=most).collect()
        assert sorted(((r.doc_id, list(r.item_ids)) for r in got), key=key) == want
        assert all(r.contaminated == bool(r.item_ids) and r.n_items == len(r.item_ids) and (r.best_share > 0) == r.contaminated for r in got)
        both.append(sorted(((r.doc_id, list(r.item_ids), r.best_share) for r in got), key=key))
        clash = docs.selectExpr("*", "1 AS _hits", "2 AS k", "3 AS item_id", "4 AS part", "5 AS share", "6 AS seed")
        assert len(D.contaminated(clash.selectExpr("struct(*) AS whole", "text"), bench, ["whole"], most).collect()) == len(rows)
        assert not any(r.contaminated for r in D.contaminated(docs, bench.limit(0), most=most).collect())
        assert D.contaminated(docs.limit(0), bench, most=most).collect() == []
    assert both[0] == both[1]
    assert any(k for _, k in want) and not all(k for _, k in want)


def test_sharding(spark):
    rows = [(i, "x" * (i % 50), None, None, None) for i in range(500)] + [(7, "y" * 40, "", "", 0)] * 60 + [(None, None, None, None, None)] * 3 + [(900, "z" * 900, "", "", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sharding.extendible_shards(df, "doc_id", F.octet_length("text"), 300).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == sorted((r[0] or -1, len(r[1] or "")) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for name, part in by.items():
        total = sum(r.n_bytes for r in part)
        assert all((r.shard_bytes, r.shard_rows, r.depth) == (total, len(part), len(name)) for r in part)
        assert total <= 300 or (len(part) == 1 and part[0].oversized)
        assert not any(other != name and other.startswith(name) for other in by)
        assert not name or total + sum(r.n_bytes for o, p in by.items() if o != name and o.startswith(name[:-1]) for r in p) > 300 or name[:-1] == ""
    assert sharding.extendible_shards(df.limit(0), "doc_id", F.octet_length("text"), 300).collect() == []
