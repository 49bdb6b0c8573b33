"""Small files through Hadoop's file systems, so any store Spark knows will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def is_link(self, name: str = "") -> bool:
        path, fs = self._path(name)
        try:
            return fs.getFileLinkStatus(path).isSymlink()
        except Exception:  # stores without links say so in their own ways
            return False

    def read(self, name: str) -> str:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet, in one rename; False if it is."""
        path, fs = self._path(name)
        part, _ = self._path(f"{name}.{uuid.uuid4().hex}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        done = not fs.exists(path) and fs.rename(part, path)
        if not done:
            fs.delete(part, False)
        return done

    def remove(self, name: str = "") -> bool:
        path, fs = self._path(name)
        return fs.delete(path, True)

    def names(self, name: str = "") -> list[str]:
        path, fs = self._path(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def size(self) -> tuple[int, int]:
        """(files, bytes) below the root."""
        path, fs = self._path("")
        found = fs.getContentSummary(path)
        return found.getFileCount(), found.getLength()
