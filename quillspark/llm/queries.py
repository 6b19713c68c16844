"""The thin queries over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, langid, lm, minhash, packing, pii, quality, sharding, substrings
from .common import table

SHARD_BYTES = 1 << 20


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted_language(docs, langid.train(docs))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats_removed(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), SHARD_BYTES)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_lm": op1_lm,
    "op2_embeddings": op2_embeddings,
    "op3_language": op3_language,
    "op4_substrings": op4_substrings,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_decontaminate": op7_decontaminate,
    "op8_sharding": op8_sharding,
    "op9_minhash": op9_minhash,
    "op10_quality": op10_quality,
}

ORACLES = {
    "op2_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e,
                            coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
           WHERE a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
     n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
     r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
     c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op9_minhash": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
     l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.both >= 85 * (x.n + y.n - p.both)),
     r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
     c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.a = w.doc_id LEFT JOIN n USING (doc_id)""",
    "op8_sharding": f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
     d AS (SELECT unnest(generate_series(0, 40))::INT AS depth),
     s AS (SELECT depth, h >> (60 - depth) AS p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM r, d GROUP BY ALL),
     m AS (SELECT doc_id, n_bytes, h, min(s.depth) AS depth FROM r JOIN s ON s.p = r.h >> (60 - s.depth)
           WHERE s.shard_bytes <= {SHARD_BYTES} OR s.shard_rows = 1 GROUP BY ALL)
SELECT m.doc_id, m.n_bytes, CASE WHEN m.depth = 0 THEN '' ELSE lpad(bin(s.p), m.depth, '0') END AS shard, m.depth,
       s.shard_bytes, s.shard_rows, s.shard_bytes > {SHARD_BYTES} AS oversized
FROM m JOIN s ON s.depth = m.depth AND s.p = m.h >> (60 - m.depth)""",
}
