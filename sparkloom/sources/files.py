"""A Spark data source of project files: planned by size, each file read once, hidden names included, errors as rows.

``spark.read.format("project_files").load(folder)`` lists a tree and gives ``path, length, content,
failed`` for the names that a scan reads, ignored paths left out; with the option ``paths`` (a JSON
list) it gives a row for each path, whatever it is called. Partitions hold files of about
``target_bytes``, in path order; a larger file is a partition of its own. Any file system that pyarrow
opens will do (local folders, HDFS, object stores), and all executors have to see it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .names import EXTENSIONS, IGNORED

SCHEMA = "path string, length long, content binary, failed string"
#: Bytes of files in a partition, what opening a file counts for, and bytes of a batch of rows.
TARGET_BYTES, OPENING_BYTES, BATCH_BYTES = 64 << 20, 64 << 10, 16 << 20


@dataclass
class Files(InputPartition):
    """The files that a task reads: (path as it is shown, path on the file system)."""

    root: str
    files: list[tuple[str, str]]

    def __init__(self, root: str, files: list[tuple[str, str]]):
        self.root, self.files = root, files


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", uri):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pa.fs.LocalFileSystem(), os.path.abspath(uri)


def dealt(files: list[tuple[str, str, int]], target: int) -> list[list[tuple[str, str]]]:
    """Files in path order, cut where a partition would grow beyond ``target`` bytes."""
    out: list[list[tuple[str, str]]] = []
    held = 0
    for shown, path, size in sorted(files):
        cost = size + OPENING_BYTES
        if not out or held + cost > target:
            out.append([])
            held = 0
        out[-1].append((shown, path))
        held += cost
    return out


class ProjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.paths = options.get("path"), options.get("paths")
        self.target = int(options.get("target_bytes", TARGET_BYTES))

    def partitions(self) -> list[Files]:
        if self.paths is not None:
            names = json.loads(self.paths)
            sized: list[tuple[str, str, int]] = []
            for uri in names:
                fs, path = opened(uri)
                info = fs.get_file_info(path)
                sized.append((uri, uri, info.size if info.type == pa.fs.FileType.File else 0))
            return [Files("", part) for part in dealt(sized, self.target)] or [Files("", [])]
        fs, root = opened(self.folder)
        if fs.get_file_info(root).type != pa.fs.FileType.Directory:
            raise FileNotFoundError(f"no such folder: {self.folder}")
        shown = root if isinstance(fs, pa.fs.LocalFileSystem) else self.folder.rstrip("/")
        found = []
        for info in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            path = shown + info.path[len(root) :]
            if info.type == pa.fs.FileType.File and info.path.endswith(EXTENSIONS) and not re.search(IGNORED, path):
                found.append((path, info.path, info.size or 0))
        return [Files(self.folder, part) for part in dealt(found, self.target)] or [Files(self.folder, [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        fs = opened(partition.root)[0] if partition.root else None
        for shown, path in partition.files:
            try:
                own, path = (fs, path) if fs else opened(path)
                with own.open_input_file(path) as f:
                    content = f.read()
                rows.append((shown, len(content), content, None))
                held += len(content)
            except (OSError, pa.ArrowInvalid) as e:
                reason = os.strerror(e.errno) if getattr(e, "errno", None) else type(e).__name__
                rows.append((shown, 0, None, f"can't be read: {reason}"))
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "length", "content", "failed"])


class ProjectFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProjectReader:
        return ProjectReader(dict(self.options))


def project_files(spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    spark.dataSource.register(ProjectFiles)
    return spark.read.format("project_files").option("target_bytes", str(target_bytes)).load(folder)


def listed_files(spark: SparkSession, paths: list[str], target_bytes: int = TARGET_BYTES) -> DataFrame:
    spark.dataSource.register(ProjectFiles)
    return spark.read.format("project_files").option("target_bytes", str(target_bytes)).option("paths", json.dumps(paths)).load()
