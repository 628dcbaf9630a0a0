"""Small files and folders through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def write_json(self, path: str, data: Any) -> None:
        """Replace a file by a new one written beside it, so that readers see the one or the other."""
        fs, p = self._at(path)
        fresh = self._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(data).encode()))
        out.close()
        fs.delete(p, False)
        fs.rename(fresh, p)

    def read_json(self, path: str) -> Any:
        """The file, or the one that a broken-off replacement has left."""
        path = path if self.exists(path) else f"{path}.new"
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
