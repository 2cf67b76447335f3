"""Small files beside the tables, on whatever file system Spark reads: markers, snapshots, configuration."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    is_dir: bool
    modified: int  # milliseconds
    length: int


class Store:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._new_array = spark.sparkContext._gateway.new_array

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def entry(self, path: str) -> Entry | None:
        fs, at = self._at(path)
        if not fs.exists(at):
            return None
        s = fs.getFileStatus(at)
        return Entry(s.getPath().getName(), s.isDirectory(), s.getModificationTime(), s.getLen())

    def entries(self, path: str) -> list[Entry]:
        fs, at = self._at(path)
        if not fs.exists(at):
            return []
        return [Entry(s.getPath().getName(), s.isDirectory(), s.getModificationTime(), s.getLen()) for s in fs.listStatus(at)]

    def matching(self, pattern: str) -> list[str]:
        """Paths that a glob names, sorted."""
        fs, at = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])

    def read(self, path: str) -> bytes:
        """Raises FileNotFoundError, or OSError if the file can't be read."""
        fs, at = self._at(path)
        try:
            file = fs.open(at)
            try:
                return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(file))
            finally:
                file.close()
        except Py4JJavaError as error:
            kind = FileNotFoundError if not fs.exists(at) else OSError
            raise kind(0, str(error.java_exception.getMessage()).splitlines()[0], path) from error

    def _written(self, path: str, content: bytes) -> None:
        fs, at = self._at(path)
        out = fs.create(at, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def write(self, path: str, content: bytes) -> None:
        """Put a file in the place of another, in one step for those who read it."""
        self._moved(path, content, "OVERWRITE")

    def write_new(self, path: str, content: bytes) -> bool:
        """Put a file where none is, whole or not at all; False if there is one already."""
        try:
            self._moved(path, content, "NONE")
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _moved(self, path: str, content: bytes, how: str) -> None:
        hadoop = self._jvm.org.apache.hadoop.fs
        folder, _, name = path.rpartition("/")
        temporary = f"{folder}/_{name}.{uuid.uuid4().hex}"
        self._written(temporary, content)
        fs, at = self._at(temporary)
        options = self._new_array(hadoop.Options.Rename, 1)
        options[0] = getattr(hadoop.Options.Rename, how)
        try:
            hadoop.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), self._conf).rename(fs.makeQualified(at), fs.makeQualified(hadoop.Path(path)), options)
        except Py4JJavaError:
            fs.delete(at, False)
            raise

    def move(self, path: str, to: str) -> None:
        fs, at = self._at(path)
        if not fs.rename(at, self._at(to)[1]):
            raise OSError(f"{path} can't be moved to {to}")

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def make(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)
