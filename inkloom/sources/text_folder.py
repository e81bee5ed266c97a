"""A data source of whole text files: every ``.txt`` of a folder, whatever its name begins with.

Spark's file sources pass over names that begin with ``_`` or ``.``. This one lists for itself:
the folder's own entries where the job is planned, each subfolder in the task that reads it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The source travels to the workers with the plan, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Files, and their bytes, that one task reads.
PART_FILES = 1000
PART_BYTES = 32 << 20
SCHEMA = "path string, text string"


def opened(uri: str) -> tuple[fs.FileSystem, str, str]:
    """File system, the path in it, and what stands before such paths in a full address."""
    scheme, _, rest = uri.partition(":/")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return system, path, uri[: uri.rstrip("/").rindex(path.rstrip("/"))]


def is_text(info: fs.FileInfo) -> bool:
    return info.type == fs.FileType.File and info.path.lower().endswith(".txt")


@dataclass
class Files(InputPartition):
    """Files to read, or folders whose files are listed by the task."""

    files: list[str]
    folders: list[str]


class TextFolderReader(DataSourceReader):
    def __init__(self, uri: str, recursive: bool):
        self.uri, self.recursive = uri, recursive

    def partitions(self) -> list[Files]:
        system, path, _ = opened(self.uri)
        top = system.get_file_info(path)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        if top.type == fs.FileType.File:
            return [Files([path], [])]
        parts: list[Files] = []
        held: list[str] = []
        size = 0
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.type == fs.FileType.Directory:
                if self.recursive:
                    parts.append(Files([], [info.path]))
            elif is_text(info):
                if held and (len(held) >= PART_FILES or size + info.size > PART_BYTES):
                    parts.append(Files(held, []))
                    held, size = [], 0
                held.append(info.path)
                size += info.size
        return [*parts, Files(held, [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _, before = opened(self.uri)
        for path in partition.files:
            yield self._row(system, before, path)
        for folder in partition.folders:
            for info in system.get_file_info(fs.FileSelector(folder, recursive=True)):
                if is_text(info):
                    yield self._row(system, before, info.path)

    @staticmethod
    def _row(system: fs.FileSystem, before: str, path: str) -> pa.RecordBatch:
        with system.open_input_stream(path) as stream:
            # Bytes that are not UTF-8 are dropped, all others stay.
            text = stream.read().decode("utf-8", "ignore")
        return pa.RecordBatch.from_arrays([pa.array([before + path]), pa.array([text])], names=["path", "text"])


class TextFolder(DataSource):
    """``spark.read.format("text_folder")`` with ``path``, a full address, and ``recursive``."""

    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TextFolderReader:
        return TextFolderReader(self.options["path"], self.options.get("recursive", "false").lower() == "true")
