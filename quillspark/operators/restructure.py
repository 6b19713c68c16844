"""Pages and slides as rows: merging, splitting, ranges, moving, z-order, pagination, tables from lines."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import row_numbers


def merge(parts: list[DataFrame], order: list[str], key: list[str] | None = None) -> DataFrame:
    """Parts behind each other: their rows with source (the part's number) and ordinal (from 1).

    order: what orders a part's rows; key: columns whose groups are numbered apart (documents of a corpus). Without
    a key all rows are one document, whose rows are numbered range by range.
    """
    tagged = [p.withColumn("source", F.lit(k)) for k, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if not key:
        return row_numbers(rows, ["source", *order], "ordinal")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy("source", *order)))


def lines_of(text) -> Column:
    """A text's lines that aren't blank."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x) != "")


def split_pages(df: DataFrame, text: str, pages: int | Column) -> DataFrame:
    """Texts as pages of max(1, lines / pages) lines each; the last page takes the rest. Adds page (from 1) and
    page_text; a text without lines has one empty page."""
    n = F.lit(pages) if isinstance(pages, int) else pages
    rows = df.withColumn("_lines", lines_of(text)).withColumn("_n", F.greatest(n, F.lit(1)))
    rows = rows.withColumn("_per", F.greatest(F.floor(F.size("_lines") / F.col("_n")).cast("int"), F.lit(1)))
    out = rows.withColumn("page", F.explode(F.sequence(F.lit(1), F.greatest(F.least(F.col("_n"), F.size("_lines")), F.lit(1)))))
    last = F.col("page") == F.greatest(F.least(F.col("_n"), F.size("_lines")), F.lit(1))
    start = (F.col("page") - 1) * F.col("_per") + 1
    length = F.when(last, F.size("_lines")).otherwise(F.col("_per"))
    return out.withColumn("page_text", F.array_join(F.slice("_lines", start.cast("int"), length.cast("int")), "\n")).drop("_lines", "_n", "_per")


def page_range(df: DataFrame, first: int, last: int, page: str = "page") -> DataFrame:
    """Pages first to last, from 1 and inclusive."""
    return df.where(F.col(page).between(max(1, first), last))


def removed(df: DataFrame, index: int, place: str, key: list[str] | None = None) -> DataFrame:
    """Without the row at a place (from 0); those behind it move up."""
    p = F.col(place)
    return df.where(p != index).withColumn(place, F.when(p > index, p - 1).otherwise(p))


def moved(df: DataFrame, source: int, target: int, place: str) -> DataFrame:
    """The row at a place moved to another; those between make room."""
    p = F.col(place)
    between = F.when((p > source) & (p <= target), p - 1).when((p < source) & (p >= target), p + 1).otherwise(p)
    return df.withColumn(place, F.when(p == source, F.lit(target)).otherwise(between))


def cloned(df: DataFrame, index: int, place: str) -> DataFrame:
    """The row at a place twice; those behind it move down."""
    p = F.col(place)
    shifted = df.withColumn(place, F.when(p > index, p + 1).otherwise(p))
    return shifted.unionByName(df.where(p == index).withColumn(place, F.lit(index + 1).cast(dict(df.dtypes)[place])))


def z_order(df: DataFrame, shape: Column, to: str, key: list[str], z: str = "z") -> DataFrame:
    """Shapes of a slide (key) renumbered after one of them went to the front, to the back, forward or backward."""
    w = Window.partitionBy(*key)
    at = F.max(F.when(shape, F.col(z))).over(w)
    top, low = F.max(z).over(w), F.min(z).over(w)
    target = {"front": top, "back": low, "forward": F.least(at + 1, top), "backward": F.greatest(at - 1, low)}[to]
    p = F.col(z)
    between = F.when((p > at) & (p <= target), p - 1).when((p < at) & (p >= target), p + 1).otherwise(p)
    return df.withColumn(z, F.when(at.isNull(), p).when(shape, target).otherwise(between))


def islands(df: DataFrame, marked: Column, key: list[str], order: str, name: str = "island") -> DataFrame:
    """Rows where marked holds, with the number (from 1) of their run of neighbouring marked rows within the key."""
    w = Window.partitionBy(*key).orderBy(order)
    flags = df.withColumn("_m", F.coalesce(marked, F.lit(False)))
    begins = F.col("_m") & ~F.coalesce(F.lag("_m").over(w), F.lit(False))
    return flags.withColumn(name, F.sum(begins.cast("int")).over(w)).where("_m").drop("_m")


def paginated(df: DataFrame, height: Column, room: float, key: list[str], order: str) -> DataFrame:
    """Lines with page (from 1) and y: a line that doesn't fit starts the next page. Greedy, so the lines of a key, a
    document's, are gone over in order in one task, once; lines that are equal in order come by height."""
    names = [c for c in df.columns if c not in key]
    rows = df.select(*key, *names, height.cast("double").alias("_h"))

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([(order, "ascending"), ("_h", "ascending")])
        page, y, pages, places = 1, 0.0, [], []
        for h in t["_h"].to_pylist():
            h = h or 0.0
            if y > 0 and y + h > room:
                page, y = page + 1, 0.0
            y += h
            pages.append(page)
            places.append(y)
        return t.drop_columns(["_h"]).append_column("page", pa.array(pages, pa.int32())).append_column("y", pa.array(places, pa.float64()))

    return rows.groupBy(*key).applyInArrow(fold, T.StructType([*rows.drop("_h").schema.fields, T.StructField("page", T.IntegerType()), T.StructField("y", T.DoubleType())]))


def text_rows(glyphs: DataFrame, key: list[str], y_tolerance: float = 5.0, x_tolerance: float = 10.0) -> DataFrame:
    """Positioned text as rows of cells: key, row and cells. A row holds what lies within y_tolerance of its first
    item (from the top), and neighbours whose starts differ by x_tolerance at most are one cell.

    Each comparison is with the first item of a row, not the one before, so the items of a key, a page's, are gone over in
    order in one task, once.
    """
    items = glyphs.select(*key, (-F.col("y").cast("double")).alias("_y"), F.col("x").cast("double").alias("_x"), F.col("text").alias("_t"))

    def fold(t: pa.Table) -> pa.Table:
        rows: list[list[tuple[float, str]]] = []
        anchor = None
        for r in t.select(["_y", "_x", "_t"]).sort_by([("_y", "ascending"), ("_x", "ascending"), ("_t", "ascending")]).to_pylist():
            if anchor is None or abs(anchor - r["_y"]) > y_tolerance:
                anchor = r["_y"]
                rows.append([])
            rows[-1].append((r["_x"], r["_t"] or ""))
        out = []
        for own in rows:
            own.sort()
            cells, last = [], None
            for x, text in own:
                if last is None or x - last > x_tolerance:
                    cells.append("")
                cells[-1] += text
                last = x
            out.append([c.strip(" ") for c in cells])
        first = t.select(key).slice(0, 1).take(pa.array([0] * len(out), pa.int64()))
        return first.append_column("row", pa.array(range(1, len(out) + 1), pa.int32())).append_column("cells", pa.array(out, pa.list_(pa.string())))

    schema = T.StructType([*items.select(*key).schema.fields, T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])
    return items.groupBy(*key).applyInArrow(fold, schema)
