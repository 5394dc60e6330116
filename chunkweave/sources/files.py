"""Hadoop file system calls of the driver: names and small control files, never data."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session takes a temporary folder and any other one a folder beside
    the warehouse.
    """
    context = spark.sparkContext
    set_before = context._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.master.startswith("local") and "cluster" not in context.master:
        folder = tempfile.mkdtemp(prefix="chunkweave-")
    context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def under(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def exists(self, name: str | None = None) -> bool:
        return self.fs.exists(self.under(name) if name else self.root)

    def is_folder(self) -> bool:
        return self.exists() and self.fs.getFileStatus(self.root).isDirectory()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.under(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file, whole or not at all; an existing one is an error, of two that create it at once to the second.

        Written beside and then given its name by the store's own step that fails if the name is taken: a hard link in a local file system, a rename
        elsewhere. That holds for HDFS and its like; object stores whose rename overwrites need a file system that refuses to.
        """
        new = self.under(f".{uuid.uuid4().hex}.new")
        stream = self.fs.create(new, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._named(new, name)
        finally:
            self.fs.delete(new, False)

    def move(self, old: str, name: str) -> None:
        """Give a file that lies under this folder another name, with the same promise as `create`."""
        self._named(self.under(old), name)
        self.fs.delete(self.under(old), False)

    def _named(self, new: object, name: str) -> None:
        if self.fs.getScheme() == "file":
            nio = self.jvm.java.nio.file
            local = lambda path: nio.Paths.get(self.fs.makeQualified(path).toUri().getPath(), self._none())
            try:
                nio.Files.createLink(local(self.under(name)), local(new))
            except Py4JJavaError as error:
                if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                    raise FileExistsError(name) from None
                raise
        elif self.exists(name) or not self.fs.rename(new, self.under(name)):
            raise FileExistsError(name)

    def _none(self) -> object:
        return SparkContext._gateway.new_array(self.jvm.java.lang.String, 0)

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self.fs.getFileStatus(self.under(name)).getModificationTime() / 1000

    def children(self, name: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.under(name))) if self.exists(name) else []

    def remove(self, name: str | None = None) -> None:
        self.fs.delete(self.under(name) if name else self.root, True)
