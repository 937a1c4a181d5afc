"""Tables that change: whole versions switched in one step, and one part exchanged in place.

A version is a folder of its own beside the others; it counts from the moment Spark has written its
_SUCCESS file, its last act. A reader takes the newest finished version and keeps it,
so reading while writing sees one version, and a write that dies leaves nothing that is ever read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import insert_absent, upsert


def folder(spark: SparkSession, path: str):
    """The file system of a path, the path as its own, and how it makes paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


class VersionedTable:
    """Versions of one table under ``path``, by any path Spark can write."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        fs, at, path = folder(self.spark, self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        numbers = [int(m[1]) for m in (re.fullmatch(r"v-(\d+)", n) for n in names) if m]
        return sorted(n for n in numbers if fs.exists(path(f"{self.path}/v-{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version or the one asked for; None before the first."""
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.path}/v-{known[-1] if version is None else version}")

    def write(self, rows: DataFrame, number: int | None = None) -> int:
        """The next version, or that of a given number: what an unfinished write left there is written over, a finished one stays as it is."""
        known = self.versions()
        number = (known[-1] if known else -1) + 1 if number is None else number
        if number not in known:
            rows.write.mode("overwrite").parquet(f"{self.path}/v-{number}")
        return number

    def upsert(self, rows: DataFrame, key: str, update: list[str], number: int | None = None) -> int:
        """A version in which known keys have ``update`` overwritten and new keys are added whole."""
        old = self.read()
        return self.write(rows if old is None else upsert(old, rows.select(*old.columns), key, update), number)

    def insert(self, rows: DataFrame, key: str) -> int:
        """A version with the rows whose key is new; of rows with one key, one is taken."""
        old, rows = self.read(), rows.dropDuplicates([key])
        return self.write(rows if old is None else insert_absent(old, rows, key))

    def drop_before(self, version: int) -> None:
        """Deletes versions that no reader needs any more."""
        fs, _, path = folder(self.spark, self.path)
        for n in self.versions():
            if n < version:
                fs.delete(path(f"{self.path}/v-{n}"), True)


def replace_vintage(rows: DataFrame, path: str, part: str) -> None:
    """Writes ``rows`` over those values of ``part`` that they have; files of other values are not touched."""
    rows.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
