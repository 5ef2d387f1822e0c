"""Versions of what is stored: small JSON files beside the tables they name.

The newest number counts.  A version is created, never overwritten: of two writers that
start from the same version the second fails, and nothing of its tables is named.
Files go through Hadoop's file system, so any store that Spark writes will do.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest number, 0 if there is none."""
        if not self._fs.exists(self._at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def read(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._file(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, state: dict, after: int) -> int:
        """The version that follows ``after``; an error if another writer has made it."""
        stream = self._fs.create(self._file(after + 1), False)
        try:
            stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            stream.close()
        return after + 1

    def drop(self) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)

    def _file(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._at, f"{version:08d}.json")
