"""Stored tables: versioned by manifests, cut by a key into buckets that are rewritten one by one; and bucketed catalog tables.

A version is a manifest: a small file that names the folders of each bucket and the last batch of each stream it holds.
Writers put their rows under a folder of their own first and then publish the next manifest, which must not exist yet; who
comes second looks at the manifest published meanwhile and, unless it touched the same buckets, publishes behind it.
A writer that dies before publishing leaves a folder that nobody reads, and a batch that is already in a manifest is not
applied again. Publishing is a rename that doesn't overwrite, so it is as atomic as that is in the file system.

Readers see one version whole. Untouched buckets keep their files.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_renaming = threading.Lock()


class VersionedTable:
    """A table at `path` with the columns of `schema`, in `n_buckets` buckets by the hash of `key`."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "repo", n_buckets: int = 64):
        self.spark, self.path, self.key, self.n_buckets = spark, path.rstrip("/"), key, n_buckets
        self.schema = StructType.fromDDL(schema)

    # manifests

    def _at(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, version: int | None = None) -> dict:
        """The latest manifest, or that of a version; an empty one before the first write."""
        folder, fs = self._at("manifests")
        if version is None:
            names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
            version = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
        if not version:
            return {"version": 0, "folders": {}, "batches": {}, "published": {}}
        at, fs = self._at(f"manifests/{version:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Whether this manifest became its version; false where that version exists already."""
        staged, fs = self._at(f"staged-{uuid.uuid4().hex}.json")
        stream = fs.create(staged, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        at, _ = self._at(f"manifests/{manifest['version']:012d}.json")
        fs.mkdirs(at.getParent())
        with _renaming:
            if fs.exists(at) or not fs.rename(staged, at):
                fs.delete(staged, False)
                return False
        return self.manifest(manifest["version"])["writer"] == manifest["writer"]

    # rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n_buckets)).cast("int")

    def _stage(self, rows: DataFrame) -> str:
        """Writes rows under a folder of their own, in folders by bucket and there in the order of the key."""
        name = uuid.uuid4().hex
        rows.select(*self.schema.names, self.bucket().alias("_bucket")).sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return name

    def _buckets_of(self, folder: str) -> list[str]:
        at, fs = self._at(f"data/{folder}")
        return [f.getPath().getName().removeprefix("_bucket=") for f in fs.listStatus(at) if f.getPath().getName().startswith("_bucket=")]

    def read(self, version: int | None = None, buckets: set[str] | None = None) -> DataFrame:
        """The rows of a version (the latest), or of some of its buckets, with published: the version that brought each."""
        m = self.manifest(version)
        paths = [f"{self.path}/data/{f}/_bucket={b}" for b, folders in m["folders"].items() if buckets is None or b in buckets for f in folders]
        if not paths:
            return self.spark.createDataFrame([], StructType([*self.schema.fields, *StructType.fromDDL("published int").fields]))
        rows = self.spark.read.schema(self.schema).parquet(*paths).withColumn("_folder", F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/", 1))
        published = self.spark.createDataFrame(sorted(m["published"].items()), "_folder string, published int")  # a row a write
        return rows.join(F.broadcast(published), "_folder").drop("_folder")

    def append(self, rows: DataFrame) -> int:
        """Adds rows; the version that holds them."""
        folder = self._stage(rows)
        touched = self._buckets_of(folder)
        while True:
            m = self.manifest()
            if self._publish(self._next(m, folder, {b: [*m["folders"].get(b, []), folder] for b in touched})):
                return m["version"] + 1

    def rewrite(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int | None:
        """Rewrites the buckets of the keys in `touched` as `make` says of their present rows; null where `batch` (stream, id) is in the table already."""
        buckets = {str(r[0]) for r in touched.select(self.bucket()).distinct().collect()}  # at most n_buckets
        folder, base = None, None
        while True:
            m = self.manifest()
            if batch and m["batches"].get(batch[0], -1) >= batch[1]:
                return None
            if folder is None or any(m["folders"].get(b) != base["folders"].get(b) for b in buckets):
                folder, base = self._stage(make(self.read(m["version"], buckets).drop("published"))), m
            made = set(self._buckets_of(folder))
            if self._publish(self._next(m, folder, {b: [folder] if b in made else [] for b in buckets}, batch)):
                return m["version"] + 1

    def _next(self, m: dict, folder: str, changed: dict[str, list[str]], batch: tuple[str, int] | None = None) -> dict:
        folders = {b: f for b, f in (m["folders"] | changed).items() if f}
        held = {f for fs in folders.values() for f in fs}
        published = {f: v for f, v in (m["published"] | {folder: m["version"] + 1}).items() if f in held}
        return {"version": m["version"] + 1, "writer": uuid.uuid4().hex, "folders": folders, "published": published, "batches": m["batches"] | ({batch[0]: batch[1]} if batch else {})}


def bucketed(df: DataFrame, name: str, *keys: str, n_buckets: int = 64) -> DataFrame:
    """df as a catalog table, bucketed by keys: what groups or joins by them reads it without an exchange.

    Joins on more columns than the keys need none either where spark.sql.requireAllClusterKeysForCoPartition is false. A
    bucket holds all rows of its keys, so this is for corpora of many repositories, none of which is most of the rows.
    """
    df.repartition(n_buckets, *keys).write.mode("overwrite").bucketBy(n_buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)
