"""spark.read.format("xlsx") and the like: Python data sources over files that every executor can open."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .parts import DEFAULTS, PARTS


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema, fmt: str, options: dict):
        self.names, self.fmt, self.options = schema.names, fmt, options

    def partitions(self) -> list[_File]:
        """A partition for each file."""
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(os.path.join(path, "**", f"*.{self.fmt}"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        part = self.options.get("part") or DEFAULTS[self.fmt]
        with open(partition.path, "rb") as f:
            data = f.read()
        for r in PARTS[f"{self.fmt}.{part}"].rows(data):
            yield tuple(partition.path if n == "path" else r.get(n) for n in self.names)


class _Writer(DataSourceWriter):
    """Rows with name and content, one file each; written beside its name and renamed when complete."""

    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        for r in rows:
            target = os.path.join(self.folder, r["name"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.{os.getpid()}.part", "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(f"{target}.{os.getpid()}.part", target)
        return WriterCommitMessage()


def _source(fmt: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return fmt

        def schema(self) -> str:
            part = self.options.get("part") or DEFAULTS[fmt]
            return "path string, " + PARTS[f"{fmt}.{part}"].schema

        def reader(self, schema) -> DataSourceReader:
            return _Reader(schema, fmt, dict(self.options))

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Writer(dict(self.options))

    return Source


def register(spark: SparkSession) -> None:
    """Makes every format known to spark.read and df.write (name, content)."""
    for fmt in DEFAULTS:
        spark.dataSource.register(_source(fmt))
