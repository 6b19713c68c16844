"""Templates over records: placeholders, mail merge, and rows repeated for lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formats import docx, pptx, rtf, xlsx

FIELD = re.compile(r"\{\{(\w+)\}\}")


def fill(template: str, values: dict[str, Column | str], missing: str = "keep") -> Column:
    """A template known on the driver, with {{Name}} replaced by columns; unknown names stay, nulls are empty.

    The template is cut at its placeholders once and becomes one concat, so a value that looks like a placeholder
    isn't filled again. missing: keep or empty.
    """
    parts: list[Column] = []
    end = 0
    for m in FIELD.finditer(template):
        if m.start() > end:
            parts.append(F.lit(template[end : m.start()]))
        end = m.end()
        if m[1] in values:
            v = values[m[1]]
            parts.append(F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("")))
        elif missing == "keep":
            parts.append(F.lit(m[0]))
    if end < len(template):
        parts.append(F.lit(template[end:]))
    return F.concat(*parts) if parts else F.lit("")


def merge_field(columns: list[str], name: str) -> str | None:
    """The column of a merge field: exactly, else in any case, else without spaces."""
    for norm in (lambda s: s, str.lower, lambda s: s.lower().replace(" ", "")):
        found = next((c for c in columns if norm(c) == norm(name)), None)
        if found is not None:
            return found
    return None


def fuzzy_lookup(fields: DataFrame, records: DataFrame, field: str = "field", key: str = "key", value: str = "value") -> DataFrame:
    """fields with the value of the record whose key matches exactly, else in any case, else without spaces: three
    equi-joins, as one join on any of them would compare all pairs."""
    out = fields
    for k, norm in enumerate((lambda c: c, F.lower, lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("")))):
        r = records.groupBy(norm(F.col(key)).alias(f"_k{k}")).agg(F.min_by(value, key).alias(f"_v{k}"))
        out = out.join(r, norm(F.col(field)) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
    return out.withColumn(value, F.coalesce("_v0", "_v1", "_v2")).drop("_v0", "_v1", "_v2")


def repeated_rows(lines: DataFrame, key: str, order: list[str], template: str, values: dict[str, Column | str], separator: str = "\n") -> DataFrame:
    """For each key a row template filled for all its lines, in their order. The lines of a key become one text."""
    row = lines.select(F.col(key), F.struct(*order).alias("_o"), fill(template, values).alias("_t"))
    return row.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), separator).alias("text"))


def _arrow_fill(fmt: str, template: bytes):
    make = {"docx": docx.fill, "pptx": pptx.fill, "xlsx": xlsx.fill, "rtf": rtf.fill}[fmt]

    @F.pandas_udf("binary")
    def run(record: pd.DataFrame) -> pd.Series:
        return pd.Series([make(template, {k: "" if pd.isna(v) else str(v) for k, v in r.items()}) for r in record.to_dict("records")])

    return run


def fill_documents(df: DataFrame, fmt: str, template: bytes, fields: list[str]) -> DataFrame:
    """df with content: the document template filled with each row's fields (docx, pptx, xlsx or rtf)."""
    record = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    return df.withColumn("content", _arrow_fill(fmt, template)(record))


def merge_documents(df: DataFrame, template: bytes, fields: list[str]) -> DataFrame:
    """df with content: the Word template with its merge fields replaced by each row's fields."""

    @F.pandas_udf("binary")
    def run(record: pd.DataFrame) -> pd.Series:
        return pd.Series([docx.mail_merge(template, [{k: "" if pd.isna(v) else str(v) for k, v in r.items()}]) for r in record.to_dict("records")])

    return df.withColumn("content", run(F.struct(*[F.col(f).cast("string").alias(f) for f in fields])))
