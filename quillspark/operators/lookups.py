"""Lookups between parts of documents, as joins that Catalyst plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import row_numbers


def mapped(df: DataFrame, fields: dict[str, tuple[str | None, str]]) -> DataFrame:
    """Header columns as typed fields: name to (source column or None, type). What can't be cast gets the type's
    zero: 0, empty text, false; a row never fails."""
    zero = {"string": "''", "boolean": "false", "int": "0", "bigint": "0L", "double": "0D", "float": "cast(0 as float)"}
    out: list[Column] = []
    for name, (source, kind) in fields.items():
        value = F.col(f"`{source}`").try_cast(kind) if source else F.lit(None).cast(kind)
        base = kind.partition("(")[0]
        default = F.expr(zero[base]) if base in zero else F.lit(0).cast(kind) if base == "decimal" else None
        out.append((F.coalesce(value, default) if default is not None else value).alias(name))
    return df.select(*out)


def flattened(df: DataFrame, depth: int = 1) -> DataFrame:
    """Nested records as columns named Parent.Leaf, down to depth levels; at depth 0 nested records are left out."""
    out: list[Column] = []

    def walk(kind: T.StructType, path: list[str], names: list[str], level: int) -> None:
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                if level < depth:
                    walk(f.dataType, [*path, f.name], [*names, f.name], level + 1)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias(".".join([*names, f.name])))

    walk(df.schema, [], [], 0)
    return df.select(*out)


def links(cells: DataFrame, relations: DataFrame) -> DataFrame:
    """Links (r_id, location) with their targets: url of the relation, else # and the location."""
    return cells.join(relations.select(F.col("id").alias("r_id"), "url"), "r_id", "left").withColumn("url", F.coalesce("url", F.concat(F.lit("#"), F.col("location"))))


def looked_up(df: DataFrame, table: DataFrame, key: str | list[str]) -> DataFrame:
    """df with a table's columns where its key is found, null elsewhere."""
    return df.join(table, key, "left")


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with their index in the order of their first appearance."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    return row_numbers(first, ["first", "value"], "index").withColumn("index", F.col("index") - 1)


def spine(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine entries (book, pos, idref) with the file of the manifest (book, id, href); entries without one go."""
    return items.join(manifest.withColumnRenamed("id", "idref"), ["book", "idref"])


def unhandled(parts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Parts that no known one names."""
    return parts.join(known.select(key), key, "left_anti")


def near(a: DataFrame, b: DataFrame, key: list[str], position: str, other: str, distance: int) -> DataFrame:
    """Pairs of a key whose positions are at most distance apart: an equi-join on the key and on buckets as wide as
    the distance, b standing in its own and both neighbours."""
    width = max(1, distance)
    left = a.withColumn("_b", F.floor(F.col(position) / width))
    right = b.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(other) / width) + d)))
    return left.join(right, [*key, "_b"]).where(F.abs(F.col(position) - F.col(other)) <= distance).drop("_b")


def expanded(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as times says (at least once where it is null), numbered from 0 in repeat."""
    n = F.greatest(F.coalesce(times, F.lit(1)), F.lit(0))
    return df.where(n > 0).withColumn("repeat", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")
