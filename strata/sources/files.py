"""Small file operations on any file system that Spark reads, by Hadoop's own interface."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    """A file or a folder of a listing; ``modified`` in milliseconds."""

    name: str
    is_folder: bool
    length: int
    modified: int


class Folder:
    """A folder given by a path or URI."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _p(self, name: str):
        return self._path(self.at(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._p(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._p(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read_bytes(self, name: str, start: int, n: int) -> bytes:
        """``n`` bytes of a file from ``start`` on."""
        stream = self._fs.open(self._p(name))
        try:
            stream.seek(start)
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    def entries(self, name: str = "") -> list[Entry]:
        """What lies in a folder, hidden names left out, by name; none if it isn't there."""
        found = self._fs.listStatus(self._p(name)) if self.exists(name) else []
        every = [Entry(x.getPath().getName(), x.isDirectory(), x.getLen(), x.getModificationTime()) for x in found]
        return sorted((e for e in every if e.name[0] not in "._" or e.name == "_SUCCESS" or "=" in e.name), key=lambda e: e.name)

    def write(self, name: str, text: str) -> None:
        """Make a small file at once, whole or not at all; ``FileExistsError`` if it exists, so of two writers one succeeds.

        The text is written elsewhere and then gets its name: by a link on a local disk, else by a rename
        that doesn't replace, which HDFS and its like do in one step.
        """
        jvm, draft, to = self.spark._jvm, self._p(f"_drafts/{uuid.uuid4().hex}"), self._p(name)
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(f"{text}\n".encode()))
        finally:
            stream.close()
        try:
            self._fs.mkdirs(to.getParent())
            if self._fs.getUri().getScheme() == "file":
                local = lambda p: jvm.java.io.File(self._fs.makeQualified(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(to), local(draft))
            else:
                kinds = jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(kinds, 1)
                options[0] = kinds.NONE
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(to), options)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise FileExistsError(self.at(name)) from None
            raise
        finally:
            self._fs.delete(draft, False)

    def read_whole(self, name: str) -> str | None:
        """The text of a file that was written to its end; None of one that another tool left incomplete."""
        text = self.read(name)
        return text[:-1] if text.endswith("\n") else None

    def on_exit(self) -> None:
        """The folder goes when the application ends."""
        self._fs.deleteOnExit(self._p(""))
