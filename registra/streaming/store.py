"""A table kept in hash buckets of a key: a change writes the buckets that it touches, and a manifest makes it visible.

``data/v=<version>/bucket=<n>`` holds rows; ``manifest/<version>`` lists, for each bucket, the versions whose rows make it up. A manifest is written under
another name and renamed, which is the commit: before it readers see the version before, after it the new one. A version that was
committed is never written again, and what a failed attempt left in its data folder is overwritten by the next attempt.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64  #: of a new table, which keeps the number that it was made with; one task writes a bucket, so large tables ask for more
LAYERS = 8  #: versions that make up a bucket at most; then its rows are written together
KEEP = 3  #: manifests whose rows are kept for readers


@dataclass(frozen=True)
class Manifest:
    """What makes up one version of a table: bounded by the number of buckets times ``LAYERS``."""

    version: int
    buckets: int
    schema: T.StructType
    layers: dict[int, list[int]]

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "schema": self.schema.jsonValue(), "layers": self.layers})

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], d["buckets"], T.StructType.fromJson(d["schema"]), {int(b): v for b, v in d["layers"].items()})


class BucketTable:
    """Rows in buckets below ``path``; versions are numbers that rise."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, keep: int = KEEP) -> None:
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, max(2, keep)
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------ manifests

    def versions(self) -> list[int]:
        """Committed versions that are still kept, oldest first."""
        folder = self._at(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None, before: int | None = None) -> Manifest | None:
        """Of a version; else of the newest one, or the newest one below ``before``."""
        found = [v for v in self.versions() if (version is None or v == version) and (before is None or v < before)]
        return Manifest.of(self.spark.read.text(f"{self.path}/manifest/{found[-1]}", wholetext=True).first()[0]) if found else None

    def _publish(self, m: Manifest) -> None:
        draft, final = (self._at(f"{self.path}/manifest/{n}") for n in (f"_draft-{m.version}", str(m.version)))
        out = self._fs.create(draft, True)
        out.write(bytearray(m.text().encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"version {m.version} of {self.path} was committed by another writer")

    # ------------------------------------------------ rows

    def bucket(self, key: Column, m: Manifest | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(m.buckets if m else self.buckets)).cast("int")

    def read(self, version: int | None = None, only: Iterable[int] | None = None, m: Manifest | None = None) -> DataFrame:
        """All rows, or those of some buckets, of the newest or a given version."""
        m = m or self.manifest(version)
        if m is None:
            raise ValueError(f"{self.path} holds no version")
        wanted = m.layers if only is None else {b: m.layers[b] for b in set(only) & set(m.layers)}
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, vs in sorted(wanted.items()) for v in vs]
        return self.spark.read.schema(m.schema).parquet(*paths) if paths else self.spark.createDataFrame([], m.schema)

    def commit(self, version: int, rows: DataFrame, key: Column, base: Manifest | None, append: bool = False) -> Manifest:
        """Writes ``rows`` as the new content of the buckets that they fall into, or adds them there, and publishes the version.

        With ``append`` a bucket of more than ``LAYERS`` versions is written together first.
        """
        buckets = base.buckets if base else self.buckets
        place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        known = base.schema.fields if base else []
        schema = T.StructType([*known, *(f for f in rows.schema.fields if f.name not in {k.name for k in known})])
        layers = {} if base is None else {b: list(v) for b, v in base.layers.items()}
        rows = rows.withColumn("bucket", place)
        if append and base is not None:
            deep = [b for b, v in layers.items() if len(v) >= LAYERS]
            if deep:
                old = self.read(only=deep, m=base).withColumn("bucket", place)
                rows = rows.unionByName(old, allowMissingColumns=True)
                for b in deep:
                    layers[b] = []
        data = f"{self.path}/data/v={version}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        for s in self._fs.listStatus(self._at(data)):
            name = s.getPath().getName()
            if name.startswith("bucket="):
                b = int(name[7:])
                layers[b] = [*layers.get(b, []), version] if append else [version]
        m = Manifest(version, buckets, schema, layers)
        self._publish(m)
        self._tidy()
        return m

    def _tidy(self) -> None:
        """Deletes manifests beyond the kept ones, and data folders that no kept one lists."""
        kept = self.versions()
        for v in kept[: -self.keep]:
            self._fs.delete(self._at(f"{self.path}/manifest/{v}"), False)
        listed = {(v, b) for n in kept[-self.keep :] for b, vs in self.manifest(n).layers.items() for v in vs}
        for v in self._fs.listStatus(self._at(f"{self.path}/data")):
            number = int(v.getPath().getName()[2:])
            if number > kept[-1]:
                continue  # of a writer that has not committed yet
            inside = [s.getPath() for s in self._fs.listStatus(v.getPath()) if s.getPath().getName().startswith("bucket=")]
            stale = [p for p in inside if (number, int(p.getName()[7:])) not in listed]
            for p in [v.getPath()] if len(stale) == len(inside) else stale:
                self._fs.delete(p, True)
