"""Keyed tables in buckets, whose versions share the buckets that no change touched.

A manifest names the folder of each bucket. A batch of changes reads and writes only the
buckets that its keys fall into, and its manifest takes the rest from the version
before. Manifests are written under another name and renamed, so a reader sees
a whole version or none; a batch that is run again gives the same version.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DELETE = "delete"


class _Store:
    """Files of a folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):  # noqa: ANN201
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file that appears whole: under another name first."""
        part = f"{name}.part"
        stream = self.fs.create(self.path(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(self.path(name), False)
        if not self.fs.rename(self.path(part), self.path(name)):
            raise OSError(f"could not write {name}")

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self.path(folder)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class SnapshotTable:
    """A table of one row a key.

    Rows keep when they were changed last (``_at``), and deleted keys stay as marks (``_gone``), so
    that a change that arrives late is told from a newer one: batches may come in
    any order and be cut anywhere. ``forget`` drops marks that no change can be older than.
    Buckets are by hash of the key, or else the values of a column ``by`` of whole
    numbers, where a key may have a row in each.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: tuple[str, ...], buckets: int = 64, by: str | None = None) -> None:
        self.spark, self.key, self.order, self.by = spark, key, order, by
        self.store = _Store(spark, path)
        found = self.versions()
        self.buckets = self._manifest(found[-1])["buckets"] if found else buckets

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.store.names("manifests") if n.startswith("v") and n.endswith(".json")]

    def _manifest(self, version: int) -> dict:
        return json.loads(self.store.read(f"manifests/v{version:012d}.json"))

    def _before(self, version: int | None) -> dict | None:
        found = [v for v in self.versions() if version is None or v < version]
        return self._manifest(found[-1]) if found else None

    def _folders(self, manifest: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.store.root}/{f}" for f in sorted(set(folders))])

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version (the newest), without deleted keys, of all or some buckets; None if there is none."""
        found = [v for v in self.versions() if version is None or v <= version]
        if not found:
            return None
        manifest = self._manifest(found[-1])
        folders = [f for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        return self._folders(manifest, folders).where("not _gone").drop("_gone", "_at", "_bucket")

    def apply(self, changes: DataFrame, version: int | None = None, op: str = "op") -> list[int]:
        """Apply changes (key, op, order columns, values); the buckets that were written.

        Of the changes of a key the last in the order of the ``order`` columns counts,
        whichever batch it comes in. Ties are decided by the change itself: a
        deletion wins, then the values by a hash of theirs. A null key is a key.
        """
        before = self._before(version)
        if version is None:
            found = self.versions()
            version = found[-1] + 1 if found else 0
        elif version in self.versions():
            return self._manifest(version)["written"]
        values = [c for c in changes.columns if c not in (self.key, op)]
        gone = F.coalesce(F.col(op) == DELETE, F.lit(False))
        bucket = (F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)) if self.by is None else F.col(self.by)).cast("int")
        new = changes.select(self.key, *values, F.struct(*self.order, gone.alias("gone"), F.xxhash64(*values).alias("tie")).alias("_at"), gone.alias("_gone"), bucket.alias("_bucket"))
        new = new.groupBy(self.key, "_bucket").agg(F.max_by(F.struct(*values, "_at", "_gone"), "_at").alias("x")).select(self.key, "x.*", "_bucket")
        new = new.select(self.key, *values, "_at", "_gone", "_bucket")
        work = f"{self.store.root}/work/v{version:012d}"
        new.write.mode("overwrite").parquet(work)  # a batch is read once, whatever it is
        new = self.spark.read.schema(new.schema).parquet(work)
        touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())
        folders = {} if before is None else dict(before["folders"])
        if before is not None:
            old = self._folders(before, [folders[str(b)] for b in touched if str(b) in folders])
            every = old.unionByName(new, allowMissingColumns=True)
            values = [c for c in every.columns if c not in (self.key, "_bucket")]
            new = every.groupBy(self.key, "_bucket").agg(F.max_by(F.struct(*values), "_at").alias("x")).select(self.key, "x.*", "_bucket")
        schema = new.schema
        data = f"data/v{version:012d}"
        dealt = new.repartition(max(1, len(touched)), "_bucket").withColumn("_part", F.col("_bucket"))
        dealt.write.mode("overwrite").partitionBy("_part").parquet(f"{self.store.root}/{data}")
        folders |= {str(b): f"{data}/_part={b}" for b in touched}
        manifest = {"version": version, "buckets": self.buckets, "schema": json.loads(schema.json()), "folders": folders, "written": touched}
        self.store.write(f"manifests/v{version:012d}.json", json.dumps(manifest))
        self.store.delete(f"work/v{version:012d}")
        return touched

    def bytes_written(self, version: int) -> int:
        return self.store.size(f"data/v{version:012d}")

    def expire(self, keep: int = 2) -> None:
        """Delete all but the last versions, and the folders that only these had."""
        found = self.versions()
        stay = found[-max(1, keep) :]
        needed = {f for v in stay for f in self._manifest(v)["folders"].values()}
        for version in found[: -len(stay)]:
            self.store.delete(f"manifests/v{version:012d}.json")
        for name in self.store.names("data"):
            if int(name[1:]) > stay[-1]:
                continue  # a batch that is being written
            parts = [p for p in self.store.names(f"data/{name}") if p.startswith("_part=")]
            kept = [p for p in parts if f"data/{name}/{p}" in needed]
            if not kept:
                self.store.delete(f"data/{name}")
            else:
                for p in set(parts) - set(kept):
                    self.store.delete(f"data/{name}/{p}")

    def forget(self, older: str) -> list[int]:
        """A version without marks of deleted keys for which the condition on ``_at`` holds; the buckets that had some."""
        found = self.versions()
        manifest = self._manifest(found[-1])
        rows = self._folders(manifest, list(manifest["folders"].values()))
        old = F.expr(f"_gone and ({older})")
        touched = sorted(r["_bucket"] for r in rows.where(old).select("_bucket").distinct().collect())
        if touched:
            data = f"data/v{found[-1] + 1:012d}"
            stay = self._folders(manifest, [manifest["folders"][str(b)] for b in touched]).where(~old)
            stay.repartition(len(touched), "_bucket").withColumn("_part", F.col("_bucket")).write.mode("overwrite").partitionBy("_part").parquet(f"{self.store.root}/{data}")
            have = {p[6:] for p in self.store.names(data) if p.startswith("_part=")}
            folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched} | {b: f"{data}/_part={b}" for b in have}
            self.store.write(f"manifests/v{found[-1] + 1:012d}.json", json.dumps(manifest | {"version": found[-1] + 1, "folders": folders, "written": touched}))
        return touched
