"""Small files beside the tables, through Hadoop's file systems: any store that Spark reads can hold a collection."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from pinion.errors import INTERNAL, StatusError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        try:
            stream = self.fs.open(self.path(name))
            try:
                return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError as e:  # a failed checksum, for one
            raise StatusError(INTERNAL, f"{name} cannot be read: {e.java_exception.getMessage()}") from None

    def write(self, name: str, text: str) -> None:
        """All or nothing: a temporary file is renamed into place."""
        tmp = self.path(f".{uuid.uuid4().hex}.tmp")
        out = self.fs.create(tmp, True)
        out.write(bytearray(text.encode("utf-8")))
        out.hsync()
        out.close()
        if self.fs.exists(self.path(name)):
            self.fs.delete(self.path(name), False)
        if not self.fs.rename(tmp, self.path(name)):
            raise OSError(f"cannot write {name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
