"""Numbered commits in a shared folder: the first writer of a number wins.

Files go through Hadoop's FileSystem. A commit is written under another name and then renamed, so the folder may be in
any store that Spark reads and whose rename is atomic and doesn't replace a file.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        folder = self._path(f"{self.root}/_log")
        self._fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(folder)

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/_log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_log/{version:012d}.json"))
        try:
            data = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(data)

    def latest(self) -> tuple[int, dict | None]:
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (0, None)

    def commit(self, version: int, state: dict) -> None:
        """Write commit ``version``, or raise if there is one."""
        path = self._path(f"{self.root}/_log/{version:012d}.json")
        whole = self._path(f"{self.root}/_log/.{version:012d}.{id(state)}.tmp")
        if self._fs.exists(path):
            raise Conflict(f"commit {version} exists")
        out = self._fs.create(whole, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        # a rename doesn't replace a file, so a reader sees a commit whole or not at all
        if self._fs.exists(path) or not self._fs.rename(whole, path):
            self._fs.delete(whole, False)
            raise Conflict(f"commit {version} exists")

    def folders(self, root: str) -> list[str]:
        """Names of the folders under ``root``."""
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(root)) if f.isDirectory())

    def drop_folder(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)
