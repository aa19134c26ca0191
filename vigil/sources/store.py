"""An append-only store of datasets, each a Parquet table by day of collection.

An append conforms a batch to the stored schema: shared columns are cast, missing ones are null, new ones join the
schema. The schema lies beside the data, so that reading never infers one. `ingest_batch` grows from append to append,
`ingest_seq` within one: together they tell which of two rows of equal collection time came later.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import declared


def casts_needed(incoming: T.StructType, stored: T.StructType) -> dict[str, str]:
    """The stored type of each shared column whose incoming type differs."""
    have = {f.name: f.dataType for f in stored}
    return {f.name: have[f.name].simpleString() for f in incoming if f.name in have and f.dataType != have[f.name]}


def conform(df: DataFrame, stored: T.StructType) -> DataFrame:
    """df with the stored columns in their types, nulls for those it lacks, then the columns that are new."""
    have = {f.name for f in df.schema}
    kept = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in stored]
    new = [F.col(f"`{f.name}`") for f in df.schema if f.name not in stored.names and not isinstance(f.dataType, T.NullType)]
    return df.select(*kept, *new)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """df without the columns of which every row is null, found in one pass."""
    if not df.columns:
        return df
    counts = df.agg(*(F.count(f"`{c}`").alias(c) for c in df.columns)).first()
    return df.select(*(f"`{c}`" for c in df.columns if counts[c]))


def arrived(rows: DataFrame, batch: int) -> DataFrame:
    """rows with their order of arrival."""
    return rows.drop("ingest_seq", "ingest_batch").withColumns({"ingest_seq": F.monotonically_increasing_id(), "ingest_batch": F.lit(batch).cast("bigint")})


def take_batch(fs, folder) -> int:
    """The next batch's number, which no other writer gets: its marker in the folder is made before any data, and only once."""
    taken = [int(x.getPath().getName()) for x in fs.listStatus(folder)] if fs.exists(folder) else []
    number = max(taken, default=-1) + 1
    while not fs.createNewFile(folder.suffix(f"/{number:08d}")):
        number += 1
    return number


class Store:
    """Datasets under one folder of any file system that Spark reads and writes."""

    name = "parquet"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, dataset: str) -> bool:
        return self._fs().exists(self._path(dataset, "_schema"))

    def schema(self, dataset: str) -> T.StructType:
        """The newest schema of a dataset, or the declared one before anything is written."""
        if not self.exists(dataset):
            return declared(dataset)
        newest = max(s.getPath().getName() for s in self._fs().listStatus(self._path(dataset, "_schema")))
        stream = self._fs().open(self._path(dataset, "_schema", newest))
        try:
            return T.StructType.fromJson(json.loads(stream.readUTF()))
        finally:
            stream.close()

    def _keep_schema(self, dataset: str, schema: T.StructType) -> None:
        number = len(self._fs().listStatus(self._path(dataset, "_schema"))) if self.exists(dataset) else 0
        out = self._fs().create(self._path(dataset, "_schema", f"{number:08d}.json"), False)
        out.writeUTF(schema.json())
        out.close()

    def _take_batch(self, dataset: str) -> int:
        return take_batch(self._fs(), self._path(dataset, "_batches"))

    def write(self, dataset: str, rows: DataFrame | list[dict], now: datetime) -> int:
        """Appends a batch and returns its number of rows. Rows are stamped now where the batch as a whole has no time of collection. The schema comes first, so that a batch that breaks off leaves no rows that a retry would double."""
        stored = self.schema(dataset)
        if isinstance(rows, list):
            if not rows:
                return 0
            names = list(dict.fromkeys(k for r in rows for k in r))
            given = T.StructType([f for f in stored if f.name in names])
            extra = [n for n in names if n not in stored.names]
            rows = self.spark.createDataFrame([tuple(r.get(f) for f in given.names) + tuple(None if r.get(n) is None else str(r[n]) for n in extra) for r in rows], T.StructType([*given.fields, *(T.StructField(n, T.StringType()) for n in extra)]))
        stamp = F.lit(now).cast("timestamp")
        rows = rows if "collected_at" in rows.columns else rows.withColumn("collected_at", stamp)
        out = conform(arrived(rows, self._take_batch(dataset)), stored)
        if out.schema != stored or not self.exists(dataset):
            self._keep_schema(dataset, out.schema)
        seen = Observation()
        out = out.observe(seen, F.count(F.lit(1)).alias("n"))
        out.withColumn("date", F.to_date("collected_at")).write.mode("append").partitionBy("date").parquet(f"{self.root}/{dataset}/data")
        return seen.get["n"]

    def read(self, dataset: str) -> DataFrame:
        """All rows ever appended; none, with the declared schema, for a dataset without."""
        schema = self.schema(dataset)
        if not self._fs().exists(self._path(dataset, "data")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("date", T.DateType())])).parquet(f"{self.root}/{dataset}/data").drop("date")


class CatalogStore(Store):
    """Datasets as tables of the catalog, by a prefix."""

    name = "catalog"

    def __init__(self, spark: SparkSession, prefix: str = "tel_"):
        self.spark, self.prefix = spark, prefix

    def _take_batch(self, name: str) -> int:
        """Numbers are taken beside the tables, in the warehouse."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.spark.conf.get('spark.sql.warehouse.dir')}/_batches/{name}")
        return take_batch(folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder)

    def exists(self, dataset: str) -> bool:
        return self.spark.catalog.tableExists(self.prefix + dataset)

    def schema(self, dataset: str) -> T.StructType:
        return self.spark.table(self.prefix + dataset).schema if self.exists(dataset) else declared(dataset)

    def write(self, dataset: str, rows: DataFrame, now: datetime) -> int:
        """Appends a batch; columns that are new join the table."""
        stored, name = self.schema(dataset), self.prefix + dataset
        rows = rows if "collected_at" in rows.columns else rows.withColumn("collected_at", F.lit(now).cast("timestamp"))
        out, seen = conform(arrived(rows, self._take_batch(name)), stored), Observation()
        if not self.exists(dataset):
            if out.isEmpty():
                return 0
            out.observe(seen, F.count(F.lit(1)).alias("n")).write.format("parquet").saveAsTable(name)
            return seen.get["n"]
        new = [f for f in out.schema if f.name not in stored.names]
        if new:
            self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(name)
        return seen.get["n"]

    def read(self, dataset: str) -> DataFrame:
        """All rows ever appended. Only a table that isn't there reads as empty; any other failure is one."""
        return self.spark.table(self.prefix + dataset) if self.exists(dataset) else self.spark.createDataFrame([], declared(dataset))
