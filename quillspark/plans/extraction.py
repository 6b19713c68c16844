"""Plans for mixed folders: each file goes to what its extension asks for, in one pass over the bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_supported
from ..sources.files import extract, extract_markdown, extract_text, files, named


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """path, ext and supported of every file; the bytes aren't read."""
    return files(spark, path).select("path", "ext", is_supported("ext").alias("supported"))


def unified(spark: SparkSession, path: str, markdown: bool = False) -> DataFrame:
    """path, ext and text (or Markdown) of every file; null for unsupported ones."""
    column = (extract_markdown if markdown else extract_text)("content", "ext")
    return files(spark, path).select("path", "ext", column.alias("markdown" if markdown else "text"))


# The tables that every format with tables yields, by extension.
TABLES = {"xlsx": "xlsx.rows", "xls": "xls.rows", "ods": "ods.rows", "docx": "docx.tables", "doc": "doc.tables", "pptx": "pptx.tables", "pdf": "pdf.tables", "rtf": "rtf.tables", "md": "md.tables"}


def tables(spark: SparkSession, path: str) -> DataFrame:
    """path, ext, table (sheet or number), row and cells of all tables below a path. Each branch lists its own files
    by name, so that a file's bytes are read once."""
    out = None
    for ext, part in TABLES.items():
        rows = extract(files(spark, path, named(ext)), part, ["path", "ext"])
        name = "sheet" if part.endswith(".rows") else "idx"
        rows = rows.select("path", "ext", F.col(name).cast("string").alias("table"), "row", "cells")
        out = rows if out is None else out.unionByName(rows)
    return out


def converted(df: DataFrame, source: str, target: str, content: str = "content") -> DataFrame:
    """df with the documents of its content column in another format: md to docx, pdf or html, docx to html, docx and
    pptx to pdf with their layout, rtf and doc to pdf line by line, sheets to sheets."""
    from ..formats import convert, docx, markdown, ods, pdf, registry, xls, xlsx

    def one(data: bytes) -> bytes:
        if source == "md":
            tree = markdown.parse(data.decode("utf-8", "replace"))
            return {"docx": docx.from_markdown, "pdf": pdf.from_markdown, "html": lambda t: markdown.html_page(t).encode()}[target](tree)
        if source == "docx" and target == "html":
            return docx.html(data).encode()
        if source in ("docx", "pptx") and target == "pdf":
            return {"docx": convert.docx_to_pdf, "pptx": convert.pptx_to_pdf}[source](data)
        if source in ("rtf", "doc") and target == "pdf":
            return pdf.build((registry.read_text(data, source) or "").split("\n"))
        sheets = registry.read_sheets(data, source)
        return {"xlsx": xlsx.build, "xls": xls.build, "ods": ods.build}[target](sheets)

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else one(c) for c in column], dtype=object)

    return df.withColumn(content, run(content))
