"""Arriving files as a stream: an extension over the batch sources, with the same parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import extension, is_supported
from ..sources.files import extract, extract_text

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, pattern: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """path, arrived, content and ext of files as they come; at most per_trigger in a batch."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("modificationTime").alias("arrived"), "content", extension("path").alias("ext"))


def texts(stream: DataFrame) -> DataFrame:
    return stream.where(is_supported("ext")).select("path", "arrived", extract_text("content", "ext").alias("text"))


def parts(stream: DataFrame, part: str) -> DataFrame:
    fmt = part.partition(".")[0]
    return extract(stream.where(F.col("ext") == fmt), part, ["path", "arrived"])


def counts(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Files by extension and window of their arrival; files later than the watermark are left out."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", window), "ext").agg(F.count(F.lit(1)).alias("files"))


def write_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """As Parquet, exactly once, for all files there are now."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
