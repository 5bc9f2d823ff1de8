"""Versioned knowledge tables: written as whole folders, published by one small manifest file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables of one dataset under a root folder of any file system.

    A commit writes every given table to a folder of its own and then replaces the manifest, so readers see all of it
    or nothing; earlier versions stay as backups until pruned.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path("manifests")):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(self._path("manifests")) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, str]:
        found = self.versions()
        if not found:
            return {}
        stream = self._fs().open(self._path(f"manifests/{version or found[-1]:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """The new version: the last one with the given tables replaced."""
        last = self.versions()
        now = dict(self.manifest()) if last else {}
        for name, df in tables.items():
            folder = f"data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            now[name] = folder
        version = (last[-1] if last else 0) + 1
        fs, hidden = self._fs(), self._path(f"manifests/.{version:08d}.{uuid.uuid4().hex}")
        out = fs.create(hidden)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not fs.rename(hidden, self._path(f"manifests/{version:08d}.json")):
            fs.delete(hidden, False)
            raise RuntimeError(f"version {version} was written by someone else")
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest(version)[name]}")

    def prune(self, keep: int) -> int:
        """Drops all but the last `keep` versions and the folders that only they hold; how many folders went."""
        found, fs = self.versions(), self._fs()
        live = {f for v in found[-keep:] for f in self.manifest(v).values()}
        old = {f for v in found[:-keep] for f in self.manifest(v).values()} - live
        for f in old:
            fs.delete(self._path(f), True)
        for v in found[:-keep]:
            fs.delete(self._path(f"manifests/{v:08d}.json"), False)
        return len(old)
