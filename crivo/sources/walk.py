"""Folders as tables: a data source that walks them in parallel and prunes what is excluded.

The driver looks at folders level by level until there are as many as tasks are wanted; each task then
walks the folders that it is given. An excluded folder is not entered. Contents are not read, and empty
files are listed like others.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, modificationTime timestamp, length long"
ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
BATCH = 10_000


def opened(address: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of an address, the path in it, and what stands before paths of that system in addresses."""
    if "://" not in address and not address.startswith("file:"):
        address = f"file://{address}"
    fs, top = pafs.FileSystem.from_uri(address)
    return fs, top.rstrip("/"), address[: address.find(top.rstrip("/"))] if top.rstrip("/") in address else ""


@dataclass
class Folders(InputPartition):
    paths: tuple[str, ...]
    recursive: bool


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.address, self.recursive = options["path"], options.get("recursive", "false") == "true"
        self.excludes = [x for x in options.get("excludes", "").split("\0") if x]
        self.tasks = int(options.get("tasks", "64"))

    def _excluded(self, name: str) -> bool:
        return any(fnmatch.fnmatchcase(name, x) for x in self.excludes)

    def _within(self, fs: pafs.FileSystem, path: str) -> tuple[list[pafs.FileInfo], list[str]]:
        """Files and folders directly in a folder, without excluded ones."""
        found = [f for f in fs.get_file_info(pafs.FileSelector(path)) if not self._excluded(f.base_name)]
        return [f for f in found if f.is_file], sorted(f.path for f in found if f.type == pafs.FileType.Directory)

    def partitions(self) -> list[Folders]:
        fs, top, _ = opened(self.address)
        if not self.recursive:
            return [Folders((top,), False)]
        own, open_ = [], [top]  # folders whose own files only are wanted, and those to be walked
        while open_ and len(open_) < self.tasks:
            below = [(p, self._within(fs, p)[1]) for p in open_]
            if not any(b for _, b in below):
                break
            own += [p for p, b in below if b]
            open_ = [x for p, b in below for x in (b or [p])]
        return [Folders(tuple(own[k :: self.tasks]), False) for k in range(min(self.tasks, len(own)))] + [Folders(tuple(open_[k :: self.tasks]), True) for k in range(min(self.tasks, len(open_)))]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, _, before = opened(self.address)
        rows, left = [], list(partition.paths)
        while left:
            files, below = self._within(fs, left.pop())
            if partition.recursive:
                left += below
            rows += [(before + f.path, f.base_name, f.mtime.astimezone(UTC) if f.mtime else None, f.size) for f in files]
            while len(rows) >= BATCH:
                yield self._batch(rows[:BATCH])
                rows = rows[BATCH:]
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crivo_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def walk(spark: SparkSession, path: str, recursive: bool = False, excludes: tuple[str, ...] = (), tasks: int = 64) -> DataFrame:
    """Rows (path, name, modificationTime, length) of the files in a folder, or in all below it.

    Files and folders with a name that fits an exclusion (a shell pattern) are left out, with all that is
    in such a folder. The folder must be in a store that Arrow reads by its address.
    """
    spark.dataSource.register(FolderSource)
    return spark.read.format("crivo_folder").options(path=path, recursive=str(recursive).lower(), excludes="\0".join(excludes), tasks=str(tasks)).load()
