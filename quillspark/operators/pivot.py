"""Pivot tables, computed: row, column and filter fields, five summary functions, shared items, subtotals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"Sum": F.sum, "Count": F.count, "Average": F.avg, "Max": F.max, "Min": F.min}
MOST_ITEMS = 1000  # of a column field


def _field(df: DataFrame, name: str) -> str:
    """A column by its name in any case."""
    found = next((c for c in df.columns if c.lower() == name.lower()), None)
    if found is None:
        raise KeyError(name)
    return found


def caption(function: str, field: str) -> str:
    return f"{function} of {field}"


def shared_items(df: DataFrame, field: str) -> DataFrame:
    """A field's distinct values other than null, as text in binary order."""
    c = F.col(_field(df, field)).cast("string")
    return df.select(c.alias("item")).where(F.col("item").isNotNull()).distinct().orderBy("item")


def pivot(df: DataFrame, rows: Sequence[str], data: Sequence[tuple[str, str] | tuple[str, str, str]], columns: str | None = None, items: Sequence | None = None, filters: dict[str, Sequence] | None = None, subtotals: bool = False) -> DataFrame:
    """rows by columns with data fields (field, function[, caption]).

    filters keep the rows whose fields hold one of the given values. items: the values of the column field; if
    not given they are looked up, at most MOST_ITEMS, more raise. subtotals add the row fields' rollup
    (an extension); a subtotal's null is told from a value's by the column level.
    """
    for name, values in (filters or {}).items():
        df = df.where(F.col(_field(df, name)).isin(list(values)))
    keys = [_field(df, r) for r in rows]
    aggregates: list[Column] = []
    for field, function, *rest in data:
        aggregates.append(FUNCTIONS[function](_field(df, field)).alias(rest[0] if rest else caption(function, field)))
    if columns and items is None:
        found = shared_items(df, columns).limit(MOST_ITEMS + 1).collect()
        if len(found) > MOST_ITEMS:
            raise ValueError(f"{columns} has more than {MOST_ITEMS} items")
        items = [r.item for r in found]
    if subtotals:
        if columns:
            # a rollup can't be pivoted at once: the column field becomes conditions of the aggregates
            c = F.col(_field(df, columns)).cast("string")
            cells = [FUNCTIONS[f](F.when(c == i, F.col(_field(df, x)))).alias(f"{i}_{rest[0] if rest else caption(f, x)}") for i in items for x, f, *rest in data]
            aggregates = cells
        return df.rollup(*keys).agg(*aggregates, F.grouping_id().cast("int").alias("level"))
    grouped = df.groupBy(*keys)
    if not columns:
        return grouped.agg(*aggregates)
    c = _field(df, columns)
    by = df.withColumn(c, F.col(c).cast("string")).groupBy(*keys).pivot(c, list(items)) if dict(df.dtypes)[c] != "string" else grouped.pivot(c, list(items))
    out = by.agg(*aggregates)
    if len(data) == 1:
        name = data[0][2] if len(data[0]) > 2 else caption(data[0][1], data[0][0])
        out = out.select(*keys, *[F.col(f"`{i}`").alias(f"{i}_{name}") for i in items])
    return out
