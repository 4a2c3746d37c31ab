"""Tables in versions that appear whole: several tables committed as one, merges that rewrite touched buckets only, rollback.

A version is a manifest that names each table's schema and, bucket by bucket, its folders of Parquet files. Files are written first; then the manifest
is made under the next number, which only one writer can do. A reader takes the newest manifest, so it sees a version or the one before, never
a part; what a killed writer leaves is named by no manifest. Works on file systems where making a file that exists fails (HDFS and local disks;
not plain object stores).
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from winnowry.sources.readers import exists
from winnowry.sources.scratch import remove

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


def _one_row_each(key: str, *rows: DataFrame) -> None:
    for df in rows:
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} isn't unique")


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- manifests ---

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        if not exists(self.spark, f"{self.root}/versions"):
            return []
        fs, where = self._fs(f"{self.root}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """{tables: {name: {schema, key, buckets: {bucket: [folders]}}}} of a version, by default the newest; empty before the first."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no version {version}")
        text = self.spark.read.text(f"{self.root}/versions/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text) | {"version": version}

    def _publish(self, base: int, tables: dict) -> int:
        """Make the manifest after ``base``, whole: written under another name, then renamed to a name that must be free."""
        version = base + 1
        fs, final = self._fs(f"{self.root}/versions/{version:012d}.json")
        if fs.exists(final):
            raise Conflict(f"version {version} is there already")
        _, draft = self._fs(f"{self.root}/versions/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"tables": tables}).encode()))
        out.close()
        _, claim = self._fs(f"{self.root}/versions/_claim-{version:012d}")
        if not fs.createNewFile(claim):
            raise Conflict(f"version {version} is being written")
        try:
            if fs.exists(final) or not fs.rename(draft, final):
                raise Conflict(f"version {version} is there already")
        finally:
            fs.delete(claim, False)
        return version

    # --- tables ---

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, key: str) -> dict[str, list[str]]:
        """The rows in new folders by bucket."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        fs, where = self._fs(folder)
        names = [f.getPath().getName() for f in fs.listStatus(where) if f.getPath().getName().startswith("_bucket=")]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in names}

    def _read(self, table: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        folders = [f for b, where in table["buckets"].items() if buckets is None or b in buckets for f in where]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as a version has it; the version is settled now, so later commits don't show."""
        return self._read(self.manifest(version)["tables"][name])

    def begin(self) -> Commit:
        return Commit(self)

    def rollback(self, version: int) -> int:
        """A new version that equals an older one."""
        old = self.manifest(version)["tables"]
        return self._publish(self.versions()[-1], old)

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` versions and remove folders that no kept one names, and what killed writers left. No writer may be at work. Returns
        how many folders went."""
        known = self.versions()
        fs, where = self._fs(f"{self.root}/versions")
        for left in [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("_")] if known else []:
            fs.delete(left, False)
        for version in known[:-keep] if keep else []:
            remove(self.spark, f"{self.root}/versions/{version:012d}.json")
        named = {f for v in known[-keep:] for t in self.manifest(v)["tables"].values() for where in t["buckets"].values() for f in where}
        gone = 0
        if exists(self.spark, f"{self.root}/data"):
            fs, where = self._fs(f"{self.root}/data")
            for write in fs.listStatus(where):
                held = [f"{self.root}/data/{write.getPath().getName()}/{b.getPath().getName()}" for b in fs.listStatus(write.getPath()) if b.isDirectory()]
                for folder in held:
                    if folder not in named:
                        remove(self.spark, folder)
                        gone += 1
        return gone


class Commit:
    """Changes of several tables that become one version. ``base`` is the version that they were made on."""

    def __init__(self, store: Snapshots):
        self.store = store
        found = store.manifest()
        self.base, self.tables = found["version"], dict(found["tables"])

    def replace(self, name: str, rows: DataFrame, key: str) -> Commit:
        """The whole table anew; ``key`` deals it into buckets."""
        self.tables[name] = {"schema": rows.schema.jsonValue(), "key": key, "buckets": self.store._write(rows, key)}
        return self

    def merge(self, name: str, changes: DataFrame, deleted: str | None = None) -> Commit:
        """Upsert rows with the table's columns by its key, which must be unique in ``changes``; rows whose column ``deleted`` is true are taken out. Buckets without a change
        are kept as they are: the driver learns only their numbers."""
        table, store = self.tables[name], self.store
        key, schema = table["key"], StructType.fromJson(table["schema"])
        _one_row_each(key, changes)
        touched = [str(r[0]) for r in changes.select(store._bucket(key).alias("b")).distinct().collect()]
        old = store._read(table, touched)
        stay = old.join(changes.select(key), key, "left_anti").select(*schema.names)
        new = (changes if deleted is None else changes.where(~F.coalesce(F.col(deleted), F.lit(False)))).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        written = store._write(stay.unionByName(new), key)
        buckets = {b: where for b, where in table["buckets"].items() if b not in touched} | written
        self.tables[name] = table | {"buckets": buckets}
        return self

    def publish(self) -> int:
        """All changes become the next version, or none does: ``Conflict`` if another commit came first."""
        return self.store._publish(self.base, self.tables)
