"""The pipeline against plain versions of its stages."""

import zlib
from collections import defaultdict

import pytest

import corpus_pipeline as C
from quillspark.llm import pii, quality

from .helpers import DOCS, odd_documents
from .test_filters import overlaps
from .test_minhash import brute, chains
from .test_packing import plain


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = odd_documents() + chains()[:60]
    items = [(1, " ".join(rows[2][1].split(" ")[:30])), (2, "nothing that any document holds at all in this small corpus of words here")]
    rows += [(7000 + i, "junk " * 50 + "$$$ " * i, "en", "s", 0) for i in range(1, 40)]
    rows += [(8000, rows[10][1] + " write to joe@example.com or +1 (988) 555-2485", "en", "s", 0), (8001, "some words before " + items[0][1].upper() + " and after", "en", "s", 0)]
    labels = [(r[0], int(not 7000 <= r[0] < 8000), 0) for r in rows if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(d + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(d + "/benchmark.parquet")
    return d


def redacted(text, codes):
    base, more = pii.candidates(text)
    spans = [{"kind": k, "start": a, "end": e, "base": x, "code": pii._code(text, k, a, e, x)} for x, found in ((True, base), (False, more)) for k, a, e in found]
    return pii._redacted(text, spans, codes)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    tables = [docs]
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, tables[-1], folder)
        assert out.columns == docs.columns
        tables.append(spark.createDataFrame(rows_of(out), docs.schema))
    start, good, single, clean, private = (rows_of(t) for t in tables)
    # 10
    model = quality.train(docs, spark.read.parquet(folder + "/labels.parquet"))
    score = quality.score(model, [(r[1] or "").encode() for r in start])
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(good, key=key) == sorted((r for r, s in zip(start, score) if s >= 0.7), key=key)
    assert len(good) < len(start)
    # 9
    want = brute(good, C.SIMILAR)
    ids = [r[0] for r in single if r[0] is not None]
    assert sorted(ids) == sorted({i for i, c in want.items() if i == c}) and len(single) - len(ids) == sum(r[0] is None for r in good)
    assert set(single) <= set(good) and len(single) < len(good)
    # 7
    items = rows_of(spark.read.parquet(folder + "/benchmark.parquet"))
    assert sorted(clean, key=key) == sorted((r for r in single if not any(overlaps(r[1], t) for _, t in items)), key=key)
    assert len(clean) < len(single)
    # 5
    codes = frozenset(pii.chosen(pii.trained(pii.extracted(tables[3], []))))
    assert sorted(private, key=key) == sorted(((r[0], t := None if r[1] is None else redacted(r[1], codes), *r[2:4], None if t is None else len(t)) for r in clean), key=key)
    assert not any("joe@example.com" in (r[1] or "") for r in private)
    # 6
    pieces = C.run(spark, folder).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for i, text, *_ in private:
        if sum(r[0] == i for r in private) == 1:
            ids = plain(text)
            parts = sorted(by[i], key=lambda p: p.start)
            assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))] and sum(p.length for p in parts) == len(ids)
            assert all(p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p.start : p.start + p.length])) for p in parts)
    assert sum(p.length for p in pieces) == sum(len(plain(r[1])) for r in private)


def test_clashing_columns_and_empty(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet").selectExpr("*", "1 AS score", "2 AS held_out", "3 AS spans", "4 AS contaminated", "5 AS node", "6 AS predicted", "7 AS _n")
    for data in (docs.limit(40), docs.limit(0)):
        for _, stage in C.STAGES[:-1]:
            assert stage(spark, data, folder).columns == docs.columns and stage(spark, data, folder).count() <= 40
        C.packing_stage(spark, data, folder).collect()
