"""From raw documents to packed sequences: quality, near-dedup, decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, minhash, packing, pii, quality
from quillspark.llm.common import stored, table

SIMILAR = 80  # percent, of 5-word shingles


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one value beside what an operator reads, so that no name can clash."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it learns from the labels of these documents. Null and
    empty texts are scored like any other; repeated rows share their fate; an empty table gives no rows."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(_whole(docs), model, keep=["_row"]).where("predicted = 1").select("_row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that with the least doc_id. Rows are compared as they are: those that
    merely share an id stay, repeated rows are copies. Rows without an id stay, null and empty texts too. An empty
    table gives no rows; other columns may have any name."""
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    rows = stored(_whole(docs).withColumn("_number", number), "numbered")
    groups = minhash.near_duplicates(rows.select(F.col("_number").alias("doc_id"), "text"), SIMILAR)
    groups = groups.where("doc_id is not null").select(F.col("doc_id").alias("_number"), F.col("component_id").alias("_group"))
    # summed before it is shuffled, so that a group may be of any size
    first = rows.select("_number", "doc_id").join(groups, "_number").groupBy("_group").agg(F.min(F.struct("doc_id", "_number")).alias("_first"))
    kept = rows.where("_number is not null").join(first.select("_first._number"), "_number", "left_semi")
    return kept.unionByName(rows.where("_number is null")).select("_row.*")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of the benchmark. Null and empty texts stay, and so do repeated rows; an
    empty benchmark leaves all, an empty table gives no rows."""
    found = decontaminate.contaminated(_whole(docs), table(spark, sf_dir, "benchmark"), keep=["_row"])
    return found.where(~F.col("contaminated")).select("_row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind. A null text stays null, repeated rows stay; an empty
    table gives no rows."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens. A null or empty text has its end alone; repeated rows and
    rows without an id are packed like any other; an empty table gives no rows."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# A classifier, two trained models and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
