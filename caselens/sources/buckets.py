"""Keyed tables that a batch changes in place: copy-on-write merge by hash bucket.

A store is a folder with one or more tables. A row lies in the bucket of its keys'
hash; a bucket of a table is a folder below the version that wrote it last. The
manifest of a version names, for each table and bucket, that version, and the newest
manifest is the store: it comes into place by one rename, so a reader sees all tables
of a batch or none, and a batch that dies before leaves the old state (its files are
overwritten by the next try). A batch rewrites only the buckets that its rows fall in.

Versions that no kept manifest names are removed by ``vacuum``. A batch with a number
that the store has seen is skipped, so a stream may repeat one. There is one writer at
a time. Choose ``buckets`` so that one holds about a file's worth; a bucket is read and
written by one task.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class Keyed(NamedTuple):
    """A table of a store: DDL schema and the columns that a row is known by."""

    schema: str
    keys: tuple[str, ...]


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Keyed], buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop.Path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of the newest or a kept version: version, batch, buckets and, by table, the version of each bucket."""
        if version is None:
            version = (self._versions() or [0])[-1]
        if not version:
            return {"version": 0, "batch": None, "buckets": self.buckets, "tables": {n: {} for n in self.tables}}
        found = json.loads(self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()[0])
        return found | {"tables": {n: {int(b): v for b, v in found["tables"].get(n, {}).items()} for n in self.tables}}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table, of the newest or a kept version."""
        return self._rows(name, self.manifest(version)["tables"][name])

    def _rows(self, name: str, held: dict[int, int]) -> DataFrame:
        schema = self.tables[name].schema
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{name}/version={v}/bucket={b}" for b, v in sorted(held.items())))

    def _bucket(self, name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.tables[name].keys), F.lit(n)).cast("int")

    def _write(self, df: DataFrame, path: str) -> set[int]:
        """The buckets of ``df`` (with ``bucket``) as folders below ``path``; which there are."""
        df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return {int(n.removeprefix("bucket=")) for n in self._names(path) if n.startswith("bucket=")}

    def merge(self, changes: dict[str, DataFrame], combine: dict[str, Combine], batch: int | None = None) -> int:
        """Change tables together; return the store's version.

        ``combine[name]`` makes a table's new rows from its old ones in the touched
        buckets and from ``changes[name]``; it may look at no other rows and must keep
        a row's keys. What it leaves out is gone.
        """
        now = self.manifest()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return now["version"]
        version, n, tables = now["version"] + 1, now["buckets"], dict(now["tables"])
        for name, rows in changes.items():
            # the changes are written once: read for the buckets and for the merge
            incoming = f"{self.path}/incoming/{name}"
            touched = self._write(rows.withColumn("bucket", self._bucket(name, n)), incoming)
            if not touched:
                continue
            old = self._rows(name, {b: v for b, v in tables[name].items() if b in touched})
            new = combine[name](old, self.spark.read.schema(rows.schema).parquet(*(f"{incoming}/bucket={b}" for b in sorted(touched))))
            new = new.select(*old.columns).withColumn("bucket", self._bucket(name, n))
            written = self._write(new, f"{self.path}/data/{name}/version={version}")
            tables[name] = {b: v for b, v in tables[name].items() if b not in touched} | dict.fromkeys(written, version)
        self._commit({"version": version, "batch": now["batch"] if batch is None else batch, "buckets": n, "tables": tables})
        return version

    def _commit(self, manifest: dict) -> None:
        at = self._hadoop.Path(f"{self.path}/manifest/{manifest['version']:012d}.json")
        made = self._hadoop.Path(f"{self.path}/manifest/.{manifest['version']:012d}")
        out = self._fs.create(made, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._fs.exists(at) or not self._fs.rename(made, at):
            raise RuntimeError(f"another writer made version {manifest['version']} of {self.path}")

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the newest ``keep`` manifests and the versions that none of those names; how many went."""
        versions = self._versions()
        kept, gone = versions[-max(1, keep) :], 0
        manifests = [self.manifest(v) for v in kept]
        for v in versions[: -max(1, keep)]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/manifest/{v:012d}.json"), False)
        for name in self.tables:
            used = {(b, v) for m in manifests for b, v in m["tables"][name].items()}
            for folder in self._names(f"{self.path}/data/{name}"):
                v = int(folder.removeprefix("version="))
                if v > versions[-1]:  # a batch at work
                    continue
                at = f"{self.path}/data/{name}/{folder}"
                if not any(u == v for _, u in used):
                    gone += self._fs.delete(self._hadoop.Path(at), True)
                    continue
                for b in self._names(at):
                    if b.startswith("bucket=") and (int(b.removeprefix("bucket=")), v) not in used:
                        gone += self._fs.delete(self._hadoop.Path(f"{at}/{b}"), True)
        return gone
