"""Result stores: tables whose partitions are replaced one by one, and features kept under the hash of their configuration."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write ``df`` divided by ``by``; only partitions that it has rows of are replaced, the others' files stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def canonical(value) -> str:
    """A configuration as text that doesn't depend on the order of its names or of the members of its sets."""

    def plain(v):
        if isinstance(v, Mapping):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (set, frozenset)):
            return sorted((plain(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True))
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


class FeatureCache:
    """Tables under the SHA-256 of their configuration.

    A table's files are written to a folder of their own first and counted only once a manifest names that folder. The
    manifest appears by a rename that never replaces one, so a half-written table is never read, and of
    two writers of one configuration the second finds the first one's and drops its own.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.hits, self.misses = spark, root, 0, 0
        self._jvm = spark.sparkContext._jvm
        self._files = self._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def key(config: Mapping) -> str:
        return hashlib.sha256(canonical(config).encode()).hexdigest()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _folder(self, key: str) -> str | None:
        if not self._files.exists(self._path(key, "manifest.json")):
            return None
        text = self.spark.read.text(f"{self.root}/{key}/manifest.json", wholetext=True).first().value
        return json.loads(text)["data"]

    def get(self, config: Mapping) -> DataFrame | None:
        """The table of a configuration, or None."""
        key = self.key(config)
        if folder := self._folder(key):
            self.hits += 1
            return self.spark.read.parquet(f"{self.root}/{key}/{folder}")
        self.misses += 1
        return None

    def stage(self, config: Mapping, df: DataFrame) -> str:
        """Write a table's files without publishing them; the name of their folder."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{self.key(config)}/{folder}")
        return folder

    def publish(self, config: Mapping, folder: str) -> bool:
        """Make staged files the table of a configuration. False, and they are deleted, if it has one by now."""
        key, draft = self.key(config), f"draft-{uuid.uuid4().hex}"
        stream = self._files.create(self._path(key, draft), False)
        stream.write(bytearray(json.dumps({"config": json.loads(canonical(config)), "data": folder}).encode()))
        stream.close()
        fs, context = self._jvm.org.apache.hadoop.fs, self.spark.sparkContext
        never = context._gateway.new_array(fs.Options.Rename, 0)  # no option: an existing manifest is not replaced
        files = fs.FileContext.getFileContext(self._files.getUri(), context._jsc.hadoopConfiguration())
        try:
            files.rename(self._path(key, draft), self._path(key, "manifest.json"), never)
            return True
        except Exception:
            self._files.delete(self._path(key, draft), False)
            if not self._files.exists(self._path(key, "manifest.json")):
                raise
            self._files.delete(self._path(key, folder), True)
            return False

    def get_or_build(self, config: Mapping, build: Callable[[], DataFrame]) -> DataFrame:
        found = self.get(config)
        if found is None:
            self.publish(config, self.stage(config, build()))
            found = self.spark.read.parquet(f"{self.root}/{self.key(config)}/{self._folder(self.key(config))}")
        return found
