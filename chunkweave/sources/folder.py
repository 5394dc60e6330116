"""A data source of text files that its tasks list and read themselves.

    spark.dataSource.register(TextFolder)
    spark.read.format("text_folder").option("recursive", "true").load(folder)

Each task lists the folder (or, in a recursive read, its own share of the folders below it), takes the files whose names hash to it, and sends them
in batches of bounded size: names never gather in one place. Files without bytes and hidden ones are there, which Spark's own file sources leave out. Folders are
reached by Arrow's file systems: local and mounted ones, S3, Google storage, HDFS where its library is at hand.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of files in one batch, and shares that the files of one folder are dealt to.
BATCH, SHARES = 32 << 20, 16
SCHEMA = "path string, content binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; an error where Arrow has none for it."""
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(path.removeprefix("file:"))


def readable(path: str) -> bool:
    try:
        return opened(path)[0].get_file_info(opened(path)[1]).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


class Share(InputPartition):
    """Some of the files of a folder: those whose names give this number. deep: with all that lies below."""

    def __init__(self, folder: str, number: int, of: int, deep: bool) -> None:
        self.folder, self.number, self.of, self.deep = folder, number, of, deep


class TextFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.deep = options.get("recursive", "false").lower() == "true"
        self.suffix = options.get("suffix", ".txt")
        self.names = options.get("names", "false").lower() == "true"  # without contents

    def partitions(self) -> list[InputPartition]:
        """Shares of the folder's own files and, in a recursive read, of each folder right below it, whose names are all that is listed here."""
        files, root = opened(self.path)
        below = [i.path for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory] if self.deep else []
        own = [Share(root, k, SHARES, False) for k in range(SHARES)]
        of = max(1, SHARES // max(1, len(below)))
        return own + [Share(folder, k, of, True) for folder in sorted(below) for k in range(of)]

    def found(self, share: Share) -> Iterator[tuple[fs.FileSystem, str, int]]:
        files, _ = opened(self.path)
        for info in files.get_file_info(fs.FileSelector(share.folder, recursive=share.deep)):
            mine = zlib.crc32(info.path.encode("utf-8", "surrogateescape")) % share.of == share.number
            if mine and info.type == fs.FileType.File and posixpath.basename(info.path).endswith(self.suffix):
                yield files, info.path, info.size

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        contents: list[bytes | None] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

        for files, path, size in self.found(share):
            if paths and held + size > BATCH:
                yield batch()
                paths, contents, held = [], [], 0
            paths.append(path)
            if self.names:
                contents.append(None)
            else:
                with files.open_input_stream(path) as stream:
                    contents.append(stream.read())
                held += size
            held += len(path)
        yield batch()
