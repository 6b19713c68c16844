"""Documents from rows: a file for each key, built in the task that holds the key's rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formats import calendar, contacts, docx, epub, mail, markdown, ods, pdf, pptx, rtf, xls, xlsx, xps


def _grid(rows: list[dict], columns: list[str]) -> list[list]:
    return [columns, *[[r[c] for c in columns] for r in rows]]


def _pptx(grid: list[list]) -> bytes:
    w = pptx.Writer()
    w.table(w.slide(), grid)
    return w.save()


def _text(v) -> str:
    return "" if v is None else str(v)


# Writers of a grid whose first row is the header.
TABLES: dict[str, Callable[[list[list]], bytes]] = {
    "xlsx": lambda g: xlsx.build([("Sheet1", g)]),
    "xls": lambda g: xls.build([("Sheet1", g)]),
    "ods": lambda g: ods.build([("Sheet1", g)]),
    "docx": lambda g: docx.Writer().table(g).save(),
    "pptx": _pptx,
    "pdf": lambda g: pdf.Writer().table(g).save(),
    "rtf": lambda g: rtf.build([{"kind": "table", "rows": [[_text(v) for v in r] for r in g]}]),
    "md": lambda g: markdown.markdown(markdown.document(markdown.table([[markdown._inline_md([markdown.node("text", text=_text(v))]) for v in r] for r in g]))).encode(),
}
# Writers of records that already have the fields of the format's schema.
RECORDS: dict[str, Callable[[list[dict]], bytes]] = {
    "vcf": lambda rows: contacts.build(rows).encode(),
    "ics": lambda rows: calendar.build({"events": rows}).encode(),
    "epub": lambda rows: epub.build({"chapters": rows}),
    "eml": lambda rows: mail.build(rows[0]),
    "xps": lambda rows: xps.build([_text(r["text"]).split("\n") for r in rows]),
}


def documents(df: DataFrame, key: str, fmt: str, columns: list[str] | None = None, order: str | None = None, build: Callable[[list[dict]], bytes] | None = None) -> DataFrame:
    """key, name and content: one document for each value of key, with its rows in order.

    A document is built from all its rows at once, as its format needs; keys must be of bounded size, e.g. a
    row number divided by the rows a file may have. A null key is a document of its own. build makes the bytes from
    the rows in another way than a plain table or list of records.
    """
    columns = columns or [c for c in df.columns if c not in (key, order)]
    build = build or RECORDS.get(fmt) or (lambda rows: TABLES[fmt](_grid(rows, columns)))
    source = df.select(F.col(key).alias("_key"), *([F.col(order).alias("_order")] if order else []), *columns)
    kind = source.schema["_key"].dataType

    def one(t: pa.Table) -> pa.Table:
        if order:
            t = t.sort_by("_order")
        name = _text(t.column("_key")[0].as_py()) or "null"
        rows = [{k: dict(v) if isinstance(v, list) and v and isinstance(v[0], tuple) else v for k, v in r.items()} for r in t.select(columns).to_pylist()]
        return pa.table({"_key": t.column("_key").slice(0, 1), "name": pa.array([f"{name}.{fmt}"]), "content": pa.array([build(rows)], pa.binary())})

    out = source.groupBy("_key").applyInArrow(one, f"_key {kind.simpleString()}, name string, content binary")
    return out.withColumnRenamed("_key", key)


def write_files(df: DataFrame, path: str, fmt: str) -> None:
    """name and content as files below a path that all executors share. sources.register() comes first."""
    df.select("name", "content").write.format(fmt).mode("append").save(path)
