"""Tables kept as versions of key-hash buckets, for merges that do not rewrite what they do not touch.

A version is a manifest: which folder holds which bucket. A merge reads the buckets its batch falls into, writes these anew
and commits a manifest that takes all other buckets over as they are. The commit is the rename of one small file, refused
where the version exists: readers see the old version or the new one, a merge that fails leaves nothing but unreferenced
files, and a batch that runs again finds its version committed and changes nothing. There is one writer at a time.

Readers pin the version they read; ``expire`` removes old versions that nobody has pinned, and files no kept version names.

Buckets are even, as they follow a hash of the whole key; choose their number so that a bucket fits a task. Only
manifests (a line per bucket) and the numbers of touched buckets reach the driver, never rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import settled

BUCKETS = 64
BUCKET = "key_bucket"


class Files:
    """The few file operations needed, on whatever store the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Make the file appear at once and whole; false if it is there already."""
        draft = f"{os.path.dirname(name)}/.{os.path.basename(name)}-{os.urandom(8).hex()}"
        stream = self.fs.create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not self.fs.exists(self.path(name)) and self.fs.rename(self.path(draft), self.path(name))
        if not done:
            self.delete(draft)
        return bool(done)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Snapshots:
    """Versions of one table. ``keys`` name the columns whose hash picks a row's bucket; a merge must not change them."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, keys or [], buckets
        self.files = Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.root}/versions") if n.isdigit())

    def manifest(self, version: int) -> dict:
        return json.loads(self.files.text(f"{self.root}/versions/{version}"))

    def before(self, version: int) -> dict:
        """Manifest of the newest version below ``version``."""
        older = [v for v in self.versions() if v < version]
        return self.manifest(older[-1]) if older else {"buckets": {}, "facts": {}}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; later merges do not change them."""
        known = self.versions()
        if version is None and not known:
            return self._rows([])
        return self._rows(self.manifest(known[-1] if version is None else version)["buckets"].values())

    def merge(self, step: Callable[[DataFrame, DataFrame], DataFrame], batch: DataFrame, version: int) -> int:
        """Commit ``version`` as ``step`` (touched rows, batch) over the version before; returns the buckets rewritten."""
        if version in self.versions():
            return 0
        old = self.before(version)["buckets"]
        placed = settled(batch.withColumn(BUCKET, self._bucket()))
        touched = {str(r[0]) for r in placed.select(BUCKET).distinct().collect()}  # numbers below ``buckets``
        made = {}
        if touched:
            current = self._rows([path for number, path in old.items() if number in touched])
            made = self._write(step(current, placed.drop(BUCKET)), version, len(touched))
            if not set(made) <= touched:
                raise ValueError("a merge must not change the key columns of a row")
        self._commit(version, {**{n: p for n, p in old.items() if n not in touched}, **made})
        return len(touched)

    def replace(self, rows: DataFrame, facts: dict | None = None, version: int | None = None) -> int:
        """Commit a version that holds just these rows: all of them or, after a failure, none."""
        if version is None:
            version = max(self.versions(), default=0) + 1
        elif version in self.versions():
            return version
        self._commit(version, self._write(rows, version, self.buckets), facts)
        return version

    def pin(self, reader: str, version: int) -> None:
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        self.unpin(reader)
        self.files.publish(f"{self.root}/pins/{reader}", str(version))

    def unpin(self, reader: str) -> None:
        self.files.delete(f"{self.root}/pins/{reader}")

    def pinned(self) -> set[int]:
        return {int(self.files.text(f"{self.root}/pins/{n}")) for n in self.files.names(f"{self.root}/pins") if not n.startswith(".")}

    def expire(self, keep: int = 1) -> list[int]:
        """Remove all but the newest ``keep`` versions and the pinned ones; returns what went."""
        known = self.versions()
        kept = set(known[-keep:]) | self.pinned()
        gone = [v for v in known if v not in kept]
        used = {path for v in known if v in kept for path in self.manifest(v)["buckets"].values()}
        for v in gone:
            self.files.delete(f"{self.root}/versions/{v}")
        for folder in self.files.names(f"{self.root}/data"):
            if int(folder.split("-")[0]) > max(known, default=0):
                continue  # a merge under way
            at = f"{self.root}/data/{folder}"
            parts = [n for n in self.files.names(at) if n.startswith(BUCKET)]
            live = [n for n in parts if f"{at}/{n}" in used]
            for n in [at] if not live else [f"{at}/{n}" for n in parts if n not in live]:
                self.files.delete(n)
        return gone

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, paths) -> DataFrame:
        paths = list(paths)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, version: int, width: int) -> dict[str, str]:
        at = f"{self.root}/data/{version}-{os.urandom(8).hex()}"
        dealt = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(BUCKET, self._bucket())
        dealt.repartition(width, BUCKET).write.partitionBy(BUCKET).parquet(at)
        return {n.split("=")[1]: f"{at}/{n}" for n in self.files.names(at) if n.startswith(BUCKET)}

    def _commit(self, version: int, buckets: dict[str, str], facts: dict | None = None) -> None:
        text = json.dumps({"version": version, "buckets": buckets, "facts": facts or {}})
        if not self.files.publish(f"{self.root}/versions/{version}", text):
            raise RuntimeError(f"version {version} was committed by another writer")
