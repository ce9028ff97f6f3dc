"""Tables that change together: written aside, then published as one version by a single rename.

A folder holds data, one folder for each table written, and versions, one small file for each version, which lists the
tables' folders. A version's number is its file's name, so readers that take the greatest see all tables of one version,
the old one until the new one's file is there and never a half of it; one that pins a number goes on reading that one. A
writer that fails leaves nothing that a reader looks at, and of two writers that start from the same version one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Published:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._kinds: dict[str, dict] = {}  # of tables written here and not yet published

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(folder) if f.getPath().getName().isdigit())

    def version(self) -> int:
        """The one that readers see; 0 before there is any."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int | None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "schemas": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/versions/{version:010d}").collect()))

    def listed(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table of a version, by default the last."""
        return self._manifest(version)["tables"]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        held = self._manifest(version)
        if name not in held["tables"]:
            raise ValueError(f"{self.root} has no table {name!r} in version {version or self.version()}")
        reader = self.spark.read.schema(StructType.fromJson(held["schemas"][name]))
        first, *rest = (reader.parquet(p) for p in held["tables"][name])
        for more in rest:
            first = first.unionByName(more)
        return first

    def written(self, name: str, path: str) -> DataFrame:
        """A table that has been written and not yet published."""
        return self.spark.read.schema(StructType.fromJson(self._kinds[name])).parquet(path)

    def write(self, name: str, rows: DataFrame, by: Sequence[str] = ()) -> str:
        """Writes a table aside, in folders by the columns given, and returns its folder; no reader sees it until it is published."""
        path = f"{self.root}/data/{uuid.uuid4().hex}/{name}"
        rows.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        self._kinds[name] = json.loads(rows.schema.json())
        return path

    def publish(self, tables: Mapping[str, Sequence[str]], after: int | None = None) -> int:
        """Makes folders that are written the next version, by one rename. after: the version that the writer started from."""
        last = self.version()
        after = last if after is None else after
        target = self._path(f"{self.root}/versions/{after + 1:010d}")
        if last != after or self._files.exists(target):
            raise RuntimeError(f"{self.root}: version {after + 1} has been published by another writer")
        aside = self._path(f"{self.root}/aside/{uuid.uuid4().hex}")
        out = self._files.create(aside, False)
        try:
            schemas = self._manifest(after)["schemas"] | self._kinds
            out.write(bytearray(json.dumps({"tables": {k: list(v) for k, v in tables.items()}, "schemas": {k: schemas[k] for k in tables}}).encode()))
        finally:
            out.close()
        self._files.mkdirs(target.getParent())
        if not self._files.rename(aside, target):
            raise RuntimeError(f"{self.root}: version {after + 1} has been published by another writer")
        return after + 1

    def replace(self, tables: Mapping[str, DataFrame], after: int | None = None) -> int:
        """Writes and publishes tables in place of those of the same names; others stay as they are."""
        after = self.version() if after is None else after
        kept = self.listed(after)
        return self.publish(kept | {name: [self.write(name, rows)] for name, rows in tables.items()}, after)

    def append(self, tables: Mapping[str, DataFrame], after: int | None = None, by: Mapping[str, Sequence[str]] | None = None) -> int:
        """Writes and publishes further rows of tables."""
        after = self.version() if after is None else after
        kept = self.listed(after)
        return self.publish(kept | {name: [*kept.get(name, []), self.write(name, rows, (by or {}).get(name, ()))] for name, rows in tables.items()}, after)

    def expire(self, keep: int = 2) -> list[str]:
        """Forgets all but the last versions and deletes what only they held, and what was written and never published. Not to be run beside a writer."""
        versions = self.versions()
        live = {p for v in versions[-keep:] for paths in self.listed(v).values() for p in paths}
        for v in versions[:-keep]:
            self._files.delete(self._path(f"{self.root}/versions/{v:010d}"), False)
        gone = []
        data = self._path(f"{self.root}/data")
        for folder in self._files.listStatus(data) if self._files.exists(data) else []:
            for one in self._files.listStatus(folder.getPath()):
                path = f"{self.root}/data/{folder.getPath().getName()}/{one.getPath().getName()}"
                if path not in live:
                    self._files.delete(one.getPath(), True)
                    gone.append(path)
        return gone
