import re

from pyspark.sql import functions as F

from quillspark.llm import sharding as S

LIMIT = 2000


def test_written_shards_split_a_hot_key(spark, tmp_path):
    rows = [(7 if i % 3 == 0 else i, f"row {i} " + "x" * (i % 40)) for i in range(300)] + [(None, "without a key"), (1, None), (1, None), (2, "y" * 3000)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    S.write_shards(df, "id", F.octet_length("text"), LIMIT, str(tmp_path / "out"))
    got, sizes = [], {}
    for r in spark.read.parquet(str(tmp_path / "out")).select("id", "text", F.input_file_name().alias("file")).collect():
        got.append((r.id, r.text))
        sizes.setdefault(re.search("shard=([^/]*)", r.file)[1], []).append(len(r.text or ""))
    assert sorted(map(str, got)) == sorted(map(str, rows))
    assert all(sum(b) <= LIMIT or len(b) == 1 for b in sizes.values())
    assert sum(sum(b) > LIMIT for b in sizes.values()) == 1


def test_written_shards_of_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "b"), (None, None, None)], "id bigint, shard string, Shard_ string")
    assert S.write_shards(df, "id", F.octet_length("shard"), LIMIT, str(tmp_path / "a")) == "shard__"
    assert sorted(tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "a")).fillna(0, ["id"]).fillna("").collect()) == [(0, "", ""), (1, "a", "b")]
    S.write_shards(df.limit(0), "id", F.octet_length("shard"), LIMIT, str(tmp_path / "b"))
    assert not list((tmp_path / "b").glob("shard*"))
