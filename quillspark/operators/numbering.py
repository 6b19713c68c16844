"""Numbers over all rows in order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 1000
RANGES = 100


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's number (from 1) in the order of some columns, nulls first.

    Rows are dealt to ranges by boundaries that are literals, taken from the SAMPLE least hashes of the order's values;
    they are numbered within their range, and the counts of the ranges, summed before, are added. Equal values are in one
    range, so that very many rows of one value are one task's.
    """
    keys = F.struct(*order)
    sample = df.select(*order).distinct().orderBy(F.xxhash64(*order), *order).limit(SAMPLE).orderBy(*order).collect()
    kinds = [df.select(*order).schema[i].dataType for i in range(len(order))]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(order, r, kinds, strict=True)]) for r in sample[:: max(1, len(sample) // RANGES)]]
    place = F.size(F.filter(F.array(*bounds), lambda b: b <= keys)) if bounds else F.lit(0)
    rows = df.withColumn("_range", place)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each range
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_own")).cast("int")).drop("_range", "_own", "_before")
