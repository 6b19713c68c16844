"""Files as DataFrames: Spark lists and reads the bytes, tasks parse them. Any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..formats import registry
from ..functions.columns import extension, is_supported
from .parts import DEFAULTS, PARTS

BATCH_ROWS = 4096


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, content and ext of the files below a path; a pattern selects by name before anything is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content", extension("path").alias("ext"))


def named(*extensions: str) -> str:
    """A pattern for files with one of these extensions, in any case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def _mapped(df: DataFrame, keep: list[str], content: str, schema: str, rows: Callable[[bytes], Iterator[dict]], errors: str) -> DataFrame:
    """For each file the rows that it yields, beside the columns in keep. errors: raise, or of a file that can't be read
    to its end null (one row with nothing but the columns in keep) or skip (no row); its rows are held until its end then."""
    if errors not in ("raise", "null", "skip"):
        raise ValueError(errors)
    source = df.select(*keep, F.col(content).alias("_content"))
    kept = T.StructType([f for f in source.schema if f.name != "_content"])
    out = T.StructType([*kept.fields, *_schema(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[dict] = []
            owner: list[int] = []
            beside = b.select(kept.names)
            for i in range(len(b)):
                data = b.column("_content")[i].as_py()
                if data is None:
                    continue
                try:
                    found = rows(data) if errors == "raise" else list(rows(data))
                except Exception:
                    if errors == "raise":
                        raise
                    found = [{}] if errors == "null" else []
                for r in found:
                    held.append(r)
                    owner.append(i)
                    if len(held) >= BATCH_ROWS:
                        yield _batch(held, beside.take(pa.array(owner)), arrow)
                        held, owner = [], []
            if held:
                yield _batch(held, beside.take(pa.array(owner)), arrow)

    return source.mapInArrow(run, out)


def _batch(rows: list[dict], beside: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(beside.columns)
    for f in list(schema)[len(cols) :]:
        values = [r.get(f.name) for r in rows]
        if pa.types.is_map(f.type):
            values = [None if v is None else list(v.items()) for v in values]
        cols.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def extract(df: DataFrame, part: str, keep: list[str] | None = None, content: str = "content", errors: str = "raise") -> DataFrame:
    """A part (see parts.PARTS) of the files in df's content column, beside the columns in keep (default: path)."""
    p = PARTS[part]
    return _mapped(df, ["path"] if keep is None else keep, content, p.schema, p.rows, errors)


def read(spark: SparkSession, path: str, fmt: str, part: str | None = None, errors: str = "raise") -> DataFrame:
    """A part of all files of a format below a path."""
    return extract(files(spark, path, named(fmt) if fmt != "cfb" else None), f"{fmt}.{part or DEFAULTS[fmt]}", errors=errors)


def _texts(content: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([registry.read_text(c, e) for c, e in zip(content, ext, strict=True)], dtype=object)


def _markdowns(content: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([registry.read_markdown(c, e) for c, e in zip(content, ext, strict=True)], dtype=object)


def extract_text(content: Column | str, ext: Column | str) -> Column:
    """Text of files; null for unsupported ones. Made when called: workers import this module without a session."""
    return F.pandas_udf(_texts, "string")(content, ext)


def extract_markdown(content: Column | str, ext: Column | str) -> Column:
    """Markdown of files; null for unsupported ones."""
    return F.pandas_udf(_markdowns, "string")(content, ext)


def _read_any(spark: SparkSession, path: str, column: Column, name: str) -> DataFrame:
    return files(spark, path).where(is_supported("ext")).select("path", column.alias(name))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of all supported files below a path."""
    return _read_any(spark, path, extract_text("content", "ext"), "text")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return _read_any(spark, path, extract_markdown("content", "ext"), "markdown")


def read_records(df: DataFrame, part: str, schema: dict[str, str], keep: list[str] | None = None, sheet: str | None = None, content: str = "content", errors: str = "raise") -> DataFrame:
    """The tables of files as typed records: the first row of each sheet or table names its columns, in any order and
    case, so files needn't agree. part: one of rows, such as xlsx.rows or docx.tables. What a table lacks or what
    can't be cast is null; a table without a row below its header gives none. One pass over the files, no shuffle.
    """
    p = PARTS[part]
    place = "sheet" if part.endswith(".rows") else "idx"
    wanted = [n.strip().lower() for n in schema]

    def aligned(data: bytes) -> Iterator[dict]:
        here, at = None, []
        for r in p.rows(data):
            if sheet is not None and r[place] != sheet:
                continue
            cells = r["cells"]
            if r[place] != here:
                here = r[place]
                names = [(c or "").strip().lower() for c in cells]
                at = [names.index(n) if n in names else len(names) + (1 << 20) for n in wanted]
            else:
                yield {"_cells": [cells[i] if i < len(cells) else None for i in at]}

    keep = ["path"] if keep is None else keep
    rows = _mapped(df, keep, content, "_cells array<string>", aligned, errors)
    return rows.select(*keep, *[F.col("_cells")[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(schema.items())])


# Kinds of cells, from the narrowest; a column takes the widest that it holds, any mix with others is text.
_NUMBERS = {"integer": 0, "decimal": 1, "double": 2}


def read_table(cells: DataFrame, sheet: str | None = None, mode: str = "infer", schema: dict[str, str] | None = None) -> DataFrame:
    """Cells of one kind of sheet as a table: the first row names the columns, a missing name is Column{i+1},
    cells beyond the header go. mode: infer (a type for each column by its cells), string, or variant.

    The header is collected: one row of one sheet. Files must agree in it; others' columns are null. A column without a
    name that stands before the last one with a name has a type like any other.
    """
    own = cells.where(F.col("sheet") == sheet) if sheet else cells
    top, below = F.col("row") == 0, F.col("row") > 0
    seen = F.collect_set(F.when(below & (F.col("kind") != "null"), F.col("kind"))).alias("kinds")
    # one row for each column of a sheet, which has 16,384 at most
    head = own.groupBy("col").agg(F.min(F.when(top, F.col("value"))).alias("name"), F.max(top).alias("headed"), seen).orderBy("col").limit(16384).collect()
    names: dict[int, str] = {}
    for i in range(max((r.col for r in head if r.headed), default=-1) + 1):
        name = next((r.name for r in head if r.col == i and r.name), f"Column{i + 1}")
        names[i] = name if name not in names.values() else f"{name}_{i + 1}"
    kinds = {r.col: set(r.kinds) for r in head}
    body = own.where(below)
    value = F.struct("kind", "value", "number", "time") if mode != "string" else F.struct("value")
    wide = body.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col"), value.alias("v")))).alias("m"))

    def column(i: int, name: str) -> Column:
        v = F.col("m")[i]
        want = (schema or {}).get(name)
        if want:
            return v["value"].try_cast(want).alias(name)
        if mode == "string":
            return v["value"].alias(name)
        if mode == "variant":
            literal = F.when(v["kind"].isin(*_NUMBERS, "boolean"), v["value"]).otherwise(F.to_json(F.array(v["value"])))
            return F.when(v["kind"].isin(*_NUMBERS, "boolean"), F.try_parse_json(literal)).otherwise(F.try_variant_get(F.try_parse_json(literal), "$[0]", "variant")).alias(name)
        own_kinds = kinds.get(i, set())
        if own_kinds and own_kinds <= set(_NUMBERS):
            widest = max(own_kinds, key=_NUMBERS.__getitem__)
            return v["value"].try_cast({"integer": "bigint", "decimal": "decimal(38,18)", "double": "double"}[widest]).alias(name)
        if own_kinds == {"boolean"}:
            return v["value"].try_cast("boolean").alias(name)
        if own_kinds == {"datetime"}:
            return v["time"].cast("timestamp").alias(name)
        if own_kinds == {"interval"}:
            return F.make_dt_interval(secs=v["number"]).alias(name)
        return v["value"].alias(name)

    return wide.select("path", "sheet", "row", *[column(i, n) for i, n in names.items()])
