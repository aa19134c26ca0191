"""Versioned tables without a table format: each version is one folder or several, a log tells which and what each did. An append adds a folder to those of the version before.

A table can be read and overwritten in one step, since the old version stays; and any version can be read or counted.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import DDL

HISTORY = "version bigint, timestamp timestamp, operation string, operationMetrics map<string,string>"


class Snapshots:
    """One versioned table under a folder."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = name or self.path.rsplit("/", 1)[-1]

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _p(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        if not self._fs().exists(self._p("_log")):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs().listStatus(self._p("_log")) if s.getPath().getName().endswith(".json"))

    def _log(self, version: int) -> dict:
        stream = self._fs().open(self._p("_log", f"{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _parts(self, version: int) -> list[str]:
        return self._log(version).get("parts") or [f"v{version:08d}"]

    def _commit(self, df: DataFrame, at: datetime, operation: str, version: int, before: list[str]) -> int:
        part = f"v{version:08d}"
        df.write.mode("overwrite").parquet(f"{self.path}/{part}")
        out = self._fs().create(self._p("_log", f"{version:08d}.json"), False)
        out.writeBytes(json.dumps({"version": version, "timestamp": at.isoformat(), "operation": operation, "schema": df.schema.json(), "parts": [*before, part]}))
        out.close()
        return version

    def overwrite(self, df: DataFrame, at: datetime, operation: str = "WRITE", schema_change: bool = False) -> int:
        """A new version with the rows of df, which may read this table. Without schema_change its columns must be the stored ones. The log entry, written last and only once, is what makes it count."""
        have = self.versions()
        if have and not schema_change and df.schema.names != self.read().schema.names:
            raise ValueError(f"{self.name}: the columns differ; overwrite with schema_change")
        return self._commit(df, at, operation, have[-1] + 1 if have else 0, [])

    def append(self, df: DataFrame, at: datetime, operation: str = "WRITE") -> int:
        """A new version with the rows of df after those of the version before, which stay where they are."""
        have = self.versions()
        if not have:
            return self.overwrite(df, at, operation)
        stored = self.read().schema
        if sorted(df.columns) != sorted(stored.names):
            raise ValueError(f"{self.name}: the columns differ")
        same = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in stored))
        return self._commit(same, at, operation, have[-1] + 1, self._parts(have[-1]))

    def read(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        version = have[-1] if version is None and have else version
        if version not in have:
            raise ValueError(f"{self.name} has no version {version}")
        return self.spark.read.parquet(*(f"{self.path}/{p}" for p in self._parts(version)))

    def history(self) -> DataFrame:
        """version, timestamp, operation, operationMetrics of each version kept."""
        if not self.versions():
            return self.spark.createDataFrame([], HISTORY)
        log = self.spark.read.schema(HISTORY).json(f"{self.path}/_log/*.json")
        return log.select("version", "timestamp", "operation", "operationMetrics")

    def counts(self, newest: int | None = None) -> DataFrame:
        """version, n of the newest versions, by one scan of the folders that they are made of. A version that can't be read is absent, which is not zero."""
        return self._counted(self.versions()[-newest:] if newest else self.versions())

    def _counted(self, versions: list[int]) -> DataFrame:
        made = {v: self._parts(v) for v in versions}
        there = {p: self._fs().exists(self._p(p)) for parts in made.values() for p in parts}
        of = [(v, p) for v, parts in made.items() if all(there[p] for p in parts) for p in parts]
        if not of:
            return self.spark.createDataFrame([], "version bigint, n bigint")
        scan = self.spark.read.schema("__none int").parquet(*(f"{self.path}/{p}" for p in sorted({p for _, p in of})))
        each = scan.select(F.regexp_extract(F.col("_metadata.file_path"), r"/(v\d{8})/", 1).alias("part")).groupBy("part").agg(F.count("*").alias("c"))
        every = self.spark.createDataFrame(of, "version bigint, part string")
        return every.join(each, "part", "left").groupBy("version").agg(F.sum(F.coalesce("c", F.lit(0))).alias("n"))

    def count_at(self, version: int) -> int | None:
        """Rows of a version, of which only its own folders are read; None, not zero, where it can't be."""
        row = self._counted([version] if version in self.versions() else []).first()
        return None if row is None else row["n"]


def metrics_rows(metrics):
    """The writer's own count of rows, or null."""
    return F.try_element_at(metrics, F.lit("numOutputRows")).try_cast("bigint")


def collect_commits(tables: list[Snapshots], collected_at: datetime, workspace: str = "", max_counted: int = 60) -> DataFrame:
    """One row of `delta_commits` a version of each table: what it added is the difference of counts to the version before that is kept. A table whose log can't be read is left out; without any there are no rows."""
    from vigil.operators.versions import rows_added

    out = None
    for t in tables:
        try:
            counted = t.counts(max_counted + 1)
            t.history().count()
        except Exception:  # noqa: BLE001  whatever makes it unreadable: the other tables are still collected
            continue
        log = t.history().join(counted, "version", "left").withColumn("table_name", F.lit(t.name))
        part = rows_added(log, max_counted)
        part = part.select(F.lit(workspace).alias("workspace_name"), "table_name", "version", "timestamp", "operation", "rows_added", metrics_rows(F.col("operationMetrics")).alias("metrics_rows"), F.lit(collected_at).cast("timestamp").alias("collected_at"))
        out = part if out is None else out.unionByName(part)
    if out is None and tables:
        return tables[0].spark.createDataFrame([], DDL["delta_commits"] + ", collected_at timestamp")
    return out
