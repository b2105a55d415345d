"""Sinks that only append, content addresses, and published versions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.spans import content_hash


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(rows: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Appends rows whose key isn't there yet; of equal new keys one row is kept."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    if path_exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def put_raw(rows: DataFrame, path: str, key: str = "accession", content: str = "content") -> DataFrame:
    """Stores contents by key with their address. Equal bytes again are no change; the result
    lists the keys whose new bytes differ from the stored ones (those aren't stored)."""
    spark = rows.sparkSession
    hashed = rows.withColumn("content_hash", content_hash(F.col(content).cast("binary"))).withColumn("address", F.concat(F.lit("raw/sha256/"), F.substring("content_hash", 8, 64)))
    known = spark.read.parquet(path).select(key, F.col("content_hash").alias("__h")) if path_exists(spark, path) else None
    if known is None:
        hashed.dropDuplicates([key]).write.mode("append").parquet(path)
        return hashed.select(key, "content_hash").limit(0)
    diverged = hashed.join(known, key).where("content_hash <> __h").select(key, "content_hash")
    append_new(hashed, path, [key])
    return diverged


class Manifest:
    """Published versions of a dataset in a folder: data first, then a numbered file that names the active one.

    Publishing compares the version it was based on; another publisher's change in between is an error.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _last(self) -> int:
        """The number of the newest file that names a version; 0 before the first."""
        if not self.fs.exists(self._path(self.root)):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))]
        return max((int(n[7:]) for n in names if n.startswith("ACTIVE-") and n[7:].isdigit()), default=0)

    def active(self) -> str | None:
        last = self._last()
        return json.loads(self.spark.read.text(f"{self.root}/ACTIVE-{last}", wholetext=True).first()[0])["version"] if last else None

    def write(self, rows: DataFrame, pins: dict[str, str]) -> str:
        """Writes a version; the same pins give the same version, which is then left as it is."""
        version = str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(pins, sort_keys=True, separators=(",", ":"))))
        if not path_exists(self.spark, f"{self.root}/version={version}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(f"{self.root}/version={version}")
        return version

    def publish(self, version: str, based_on: str | None) -> None:
        """Makes a version the active one by a new numbered file that names it. The file is never replaced, so of two publishers
        who saw the same state only one can make it, and there is an active version at any time."""
        last = self._last()
        if self.active() != based_on:
            raise RuntimeError("another version was published meanwhile")
        try:
            out = self.fs.create(self._path(f"{self.root}/ACTIVE-{last + 1}"), False)
        except Exception as e:  # the file system says that it exists
            raise RuntimeError("another version was published meanwhile") from e
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()

    def read(self) -> DataFrame:
        version = self.active()
        if version is None:
            raise RuntimeError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/version={version}")
