"""Versioned Parquet tables: a version is a folder, a small pointer table names the current one.

A new version is written whole before the pointer moves, so a reader sees the old
or the new state, and old versions stay for snapshots.  All access goes through
Spark's file systems.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def _pointers(self, name: str) -> str:
        return f"{self.root}/{name}/_current"

    def version(self, name: str) -> int | None:
        try:
            found = self.spark.read.schema("version long").json(self._pointers(name)).agg(F.max("version")).first()[0]
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return found

    def read(self, name: str, version: int | None = None) -> DataFrame:
        version = self.version(name) if version is None else version
        if version is None:
            raise ValueError(f"no version of {name}")
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}/v{version}")

    def stage(self, name: str, df: DataFrame) -> int:
        """Write a version that isn't current yet."""
        number = (self.version(name) or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{number}")
        return number

    def promote(self, name: str, version: int) -> None:
        """Make a staged version current; an empty one is refused."""
        if self.read(name, version).isEmpty():
            raise ValueError(f"version {version} of {name} is empty")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(self._pointers(name))

    def write(self, name: str, df: DataFrame) -> int:
        number = self.stage(name, df)
        self.promote(name, number)
        return number

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to the current version, or begin the table."""
        current = self.version(name)
        if current is None:
            self.write(name, df)
        else:
            df.write.mode("append").parquet(f"{self.root}/{name}/v{current}")

    def snapshot(self, name: str, label: str) -> str:
        path = f"{self.root}/{name}/snapshot-{label}"
        self.read(name).write.mode("errorifexists").parquet(path)
        return path

    def compact(self, name: str, files: int) -> int:
        return self.write(name, self.read(name).coalesce(files))
