"""Versioned Parquet tables with one atomic commit over several of them.

A table is a base folder and the folders of upserts made since, read together: of a key the row written last holds. A
commit writes new folders, then one manifest. Readers follow the manifest, so a job that dies half-way leaves the old
version whole. The manifest is made by a rename that fails if another writer made it first; where renames are not
atomic, as in some object stores, let one writer commit at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.schemas import KEYS, SCHEMAS, columns, conform


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._closed = False

    def close(self) -> None:
        """Ends the use of this object; the tables stay."""
        self._closed = True

    def __enter__(self) -> "Store":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _names(self, folder: str = "") -> list[str]:
        path = self._path(f"{self.root}/{folder}".rstrip("/"))
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _manifests(self) -> list[int]:
        if self._closed:
            raise ValueError("the store is closed")
        return sorted(int(n.split(".")[1]) for n in self._names() if n.startswith("manifest.") and n.split(".")[1].isdigit())

    def _manifest(self, number: int) -> dict[str, list[str]]:
        rows = self.spark.read.text(f"{self.root}/manifest.{number}").collect()
        return json.loads(rows[0].value)

    def versions(self) -> dict[str, list[str]]:
        """Table -> folders of its current version, in order of writing."""
        known = self._manifests()
        return self._manifest(known[-1]) if known else {}

    def read(self, table: str) -> DataFrame:
        """The current version; an empty table if none was written."""
        folders = self.versions().get(table, [])
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        parts = [conform(self.spark.read.parquet(f"{self.root}/{f}"), table) for f in folders]
        if len(parts) == 1:
            return parts[0]
        whole = parts[0].withColumn("_n", F.lit(0))
        for i, p in enumerate(parts[1:], 1):
            whole = whole.unionByName(p.withColumn("_n", F.lit(i)))
        names = [c for c, _ in columns(table)]
        return whole.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*names), "_n").alias("_r")).select("_r.*")

    def commit(self, upserts: dict[str, DataFrame] | None = None, **tables: DataFrame) -> int:
        """Replaces the tables, and adds rows to or over those of upserts, all together; returns the number of the commit."""
        known = self._manifests()
        number = (known[-1] if known else 0) + 1
        now = self.versions()
        for name, df in {**(upserts or {}), **tables}.items():
            folder = f"{name}/v={number}-{uuid.uuid4().hex[:12]}"  # no other writer's
            conform(df, name).write.parquet(f"{self.root}/{folder}")
            now[name] = [folder] if name in tables else [*now.get(name, []), folder]
        temp, final = self._path(f"{self.root}/.manifest.{number}.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest.{number}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise RuntimeError(f"commit {number} was made by another writer")
        return number

    def compact(self, most: int = 8) -> None:
        """Rewrites the tables that are read from more than so many folders, in one commit."""
        long = [t for t, folders in self.versions().items() if len(folders) > most]
        if long:
            self.commit(**{t: self.read(t) for t in long})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last ``keep`` manifests names, and older manifests; returns how many folders went."""
        known = self._manifests()
        named = {f for n in known[-keep:] for folders in self._manifest(n).values() for f in folders}
        gone = [f"{t}/{v}" for t in SCHEMAS for v in self._names(t) if v.startswith("v=") and f"{t}/{v}" not in named]
        for path in [*gone, *(f"manifest.{n}" for n in known[:-keep])]:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        return len(gone)

    def attach(self, root: str) -> "Store":
        """A second store, to merge from; it must not be this one."""
        other = Store(self.spark, root)
        full = lambda root: self._fs.makeQualified(self._path(root)).toString().casefold()
        if full(self.root) == full(other.root):  # some file systems do not tell letter case apart
            raise ValueError("a store can't be merged into itself")
        return other
