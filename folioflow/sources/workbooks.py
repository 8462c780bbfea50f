"""Workbooks as a data source: spark.read.format("workbooks").load(path) (A5).

A partition is a file, or a file's one sheet where the query asks for one: an equality on `sheet` is pushed to the
reader, which then neither opens other sheets nor files without it. Files are found and read by Arrow's file systems
(local, HDFS, object stores); a path that only Spark can open is for read_xlsx_rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from folioflow.sources.files import _TABLE, _sheet_files, headed, sheet_rows

#: Rows in a batch.
ROWS = 10_000


@dataclass
class _File(InputPartition):
    path: str
    sheet: str | None


class Workbooks(DataSource):
    """Options: path (a file, or a folder that is searched at all depths)."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return _TABLE

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.sheet, self.none = path, None, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet",):
                self.none |= self.sheet is not None and self.sheet != f.value
                self.sheet = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        return [] if self.none else [_File(x.path, self.sheet) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.lower().endswith(".xlsx")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        names, types = ["file", "sheet", "row_idx", "headers", "cells"], [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
        with files.open_input_file(partition.path) as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
            for title, name in _sheet_files(z, set(z.namelist())):
                if partition.sheet is not None and title != partition.sheet:
                    continue
                rows = headed(partition.path, title, sheet_rows(z, name))
                for k in range(0, len(rows), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + ROWS], strict=True), types, strict=True)], names=names)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbooks)
