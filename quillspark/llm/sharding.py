"""Extendible hashing into shards under a byte limit, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS = 60


def _split(rows: DataFrame, limit: int, first_bits: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (parent, h, bytes, ...) with their bucket, and the rows of buckets that 60 bits couldn't split.

    The directory is a sum of bytes by fine prefix, added up for every shallower prefix; a bucket is the
    shallowest prefix that fits. Prefixes too full at the finest depth go on with more bits.
    """
    done, low, rest = None, 0, rows
    high = first_bits
    while True:
        fine = F.shiftright("h", BITS - high) if high else F.lit(0).cast("bigint")
        tagged = rest.withColumn("fine", fine)
        sums = tagged.groupBy("parent", "fine").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = sums.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(fine, {high} - depth)"))
        fits = (
            levels.groupBy("parent", "depth", "prefix")
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
            .where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        )
        whole = levels.select("parent", "fine", "depth", "prefix").join(fits, ["parent", "depth", "prefix"])
        directory = whole.groupBy("parent", "fine").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes", "shard_rows"), "depth").alias("at"))
        joined = stored(tagged.join(directory, ["parent", "fine"], "left"), "shards")
        here = joined.where(F.col("at").isNotNull()).select(*rest.columns, "at")
        done = here if done is None else done.unionByName(here)
        rest = joined.where(F.col("at").isNull()).select(*rest.columns)
        if rest.isEmpty():
            return done, None
        if high == BITS:
            return done, rest
        low, high = high + 1, min(BITS, high + 8)


def extendible_shards(df: DataFrame, key: str, size: F.Column, limit_bytes: int, whole: bool = False) -> DataFrame:
    """Each row's shard: the hash prefix of its bucket in an extendible hash directory.

    Returns key, n_bytes, shard (the prefix's bits), depth, shard_bytes, shard_rows, oversized.
    Bits come from md5 of the key as text. Rows that agree in all 60 of these bits (repeated keys) go on
    with bits of the row's number, so a key that holds a third of all rows is split as well.
    A single row above the limit is a shard of its own, with oversized true. A null size counts as 0
    bytes, a null key as the text 'null'. Other columns of df are not read, unless whole: then each row comes along
    as the struct _row. An empty table gives no rows.
    """
    row = [F.struct(*df.columns).alias("_row")] if whole else []
    rows = df.select(F.col(key).alias("k"), F.coalesce(size, F.lit(0)).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("row"), *row)
    rows, row = stored(rows, "sizes"), ["_row"] if whole else []
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + 3)
    key_bits = F.conv(F.substring(F.md5(F.coalesce(F.col("k").cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    row_bits = F.shiftrightunsigned(F.xxhash64("row"), 64 - BITS)
    rest, parts = rows.select("k", "bytes", "row", *row, F.lit("").alias("parent"), key_bits.alias("h")), []
    for last in (False, True):
        done, rest = _split(rest, limit_bytes, bits)
        parts.append(done)
        if rest is None:
            break
        # the parent is the whole hash; the next directory starts below it
        own = F.concat("parent", F.lpad(F.bin("h"), BITS, "0"))
        rest = rest.select("k", "bytes", "row", *row, own.alias("parent"), row_bits.alias("h"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        F.col("k").alias(key),
        F.col("bytes").alias("n_bytes"),
        F.concat("parent", F.expr("lpad(bin(at.prefix), at.depth, '0')")).alias("shard"),
        (F.length("parent") + F.col("at.depth")).cast("int").alias("depth"),
        F.col("at.shard_bytes").alias("shard_bytes"),
        F.col("at.shard_rows").alias("shard_rows"),
        (F.col("at.shard_bytes") > limit_bytes).alias("oversized"),
        *row,
    )


def write_shards(df: DataFrame, key: str, size: F.Column, limit_bytes: int, path: str) -> str:
    """df as one folder per shard of extendible_shards, each row in its own shard: the rows of a repeated key are
    split as the shards are, so shard_bytes and shard_rows are those of the folder. Null keys are one key, repeated rows
    all stay; an empty table gives no folders. Returns the name of the folders' column: shard, with underscores
    behind it where df has a column of that name."""
    name = "shard"
    while name in (c.lower() for c in df.columns):
        name += "_"
    rows = extendible_shards(df, key, size, limit_bytes, whole=True).select("_row.*", F.col("shard").alias(name))
    rows.repartition(name).write.partitionBy(name).parquet(path)
    return name
