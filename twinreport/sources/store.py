"""Tables in a folder with a manifest: name, lastmodified, success. A writer that fails leaves its table marked unsuccessful."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, lastmodified long, success boolean, version string, at long"


class Store:
    """Parquet tables under a root that Spark can write to. Each write makes a new version; readers see the last successful one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self) -> DataFrame:
        path = f"{self.root}/_manifest"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(path)

    def _mark(self, name: str, success: bool, version: str) -> None:
        now = time.time_ns()
        self.spark.createDataFrame([(name, now // 10**9, success, version, now)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")

    def status(self, name: str) -> tuple[int | None, bool | None]:
        """(lastmodified, success) of a table; (None, None) if it was never written."""
        row = self._manifest().filter(F.col("name") == name).orderBy(F.desc("at")).first()
        return (row["lastmodified"], row["success"]) if row else (None, None)

    def read(self, name: str) -> DataFrame:
        row = self._manifest().filter((F.col("name") == name) & F.col("success")).orderBy(F.desc("at")).first()
        if row is None:
            raise LookupError(f"no such table: {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/{row['version']}")

    @contextmanager
    def _writing(self, name: str) -> Iterator[str]:
        version = uuid.uuid4().hex
        self._mark(name, False, version)
        yield f"{self.root}/{name}/{version}"
        self._mark(name, True, version)

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> DataFrame:
        """Replaces the table; partitioned and sorted layouts take the place of indexes."""
        with self._writing(name) as path:
            rows = df.sortWithinPartitions(*sort_by) if sort_by else df
            rows.write.partitionBy(*partition_by).parquet(path)
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        return self.write(name, self.read(name).unionByName(df))

    def remove(self, name: str, predicate: Column) -> DataFrame:
        return self.write(name, self.read(name).filter(~F.coalesce(predicate, F.lit(False))))

    def remove_ids(self, name: str, ids: DataFrame, key: str = "bug_id") -> DataFrame:
        return self.write(name, self.read(name).join(ids.select(key).distinct(), key, "left_anti"))

    def update(self, name: str, rows: DataFrame, key: str = "bug_id") -> DataFrame:
        """Rows replace those of their keys and are added where there were none; of several rows of a key one is taken."""
        new = rows.dropDuplicates([key])
        return self.write(name, self.read(name).join(new.select(key), key, "left_anti").unionByName(new))

    def distinct(self, name: str, column: str) -> DataFrame:
        return self.read(name).select(column).distinct()

    def clean(self, name: str) -> DataFrame:
        return self.write(name, self.read(name).limit(0))


def lookup(table: DataFrame, ids: DataFrame, defaults: dict[str, Column], key: str = "bug_id") -> DataFrame:
    """The rows of many ids at once; ids without one get the defaults."""
    found = ids.select(key).join(table, key, "left")
    return found.select(key, *[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in table.columns if c != key])
