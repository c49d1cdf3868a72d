"""A streaming source of text lines over an append-only folder, with offsets and no port.

Producers add whole files whose paths sort after all earlier ones, as log
segments do.  An offset is the last path read, so it stays one short text
however long the folder grows, a query started again on its checkpoint goes on
behind it, and a batch that is repeated reads the same files.  Files are found
and read through pyarrow's file systems (local, HDFS, object stores); a task
reads one file in blocks.

    spark.dataSource.register(LineFolder)
    spark.readStream.format("line_folder").load("/data/lines")
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 4 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def listed(path: str) -> list[str]:
    """Files below ``path`` relative to it, in order; names that start with ``_`` or ``.`` are not data."""
    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [f.path[len(root) :].lstrip("/") for f in found if f.type == fs.FileType.File]
    return sorted(n for n in names if not any(part.startswith(("_", ".")) for part in n.split("/")))


def lines_of(path: str) -> Iterator[pa.RecordBatch]:
    """Lines between line feeds; a last line without one counts, an empty rest does not."""
    system, inner = _open(path)
    rest = b""
    with system.open_input_stream(inner) as source:
        while block := source.read(BLOCK):
            whole = (rest + block).split(b"\n")
            rest = whole.pop()
            if whole:
                yield _batch(whole)
    if rest:
        yield _batch([rest])


def _batch(lines: list[bytes]) -> pa.RecordBatch:
    texts = [line.decode("utf-8", "replace") for line in lines]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])


@dataclass
class File(InputPartition):
    path: str


class LineFolderReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = listed(self.path)
        return {"after": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [File(f"{self.path}/{n}") for n in listed(self.path) if start["after"] < n <= end["after"]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return lines_of(partition.path)

    def commit(self, end: dict) -> None:
        """Nothing to release: files stay where they are."""


class LineFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_folder"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> LineFolderReader:
        return LineFolderReader(self.options["path"])


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files a folder holds and of those that are added later, as a ``value`` column."""
    spark.dataSource.register(LineFolder)
    return spark.readStream.format("line_folder").load(path)
