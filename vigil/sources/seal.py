"""Sealed ground truth: what was really done to the estate. Write-once records; an end time is set once; a correction is appended, with its reason.

Nothing that detects or explains imports this module.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRUTH = (
    "fault_id string, fault_class string, target_workspace string, target_item string, mechanism string, expected_symptom string, injected_at timestamp, reverted_at timestamp, seed bigint, parameters map<string,string>, "
    "corrections array<struct<field:string,`from`:string,`to`:string,reason:string,corrected_at:string>>"
)


class NotConfigured(RuntimeError):
    """There is no ground truth to score against."""


class Seal:
    """Records under a folder, a JSON line an event; reading collapses a fault's events to its present record. Making one creates nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._folder()
        return fs.exists(p) and not self.load_all().isEmpty()

    def _append(self, df: DataFrame, seq: int) -> None:
        df.withColumn("seq", F.lit(seq)).coalesce(1).write.mode("append").json(self.path)

    def _events(self) -> DataFrame:
        fs, p = self._folder()
        schema = TRUTH + ", seq bigint, discarded boolean"
        return self.spark.read.schema(schema).json(self.path) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def load_all(self) -> DataFrame:
        """The present record of each fault, by id."""
        last = F.row_number().over(Window.partitionBy("fault_id").orderBy(F.desc("seq")))
        names = [f.split(" ")[0] for f in ("fault_id fault_class target_workspace target_item mechanism expected_symptom injected_at reverted_at seed parameters corrections").split()]
        return self._events().withColumn("__n", last).where("__n = 1 and not coalesce(discarded, false)").select(*names).orderBy("fault_id")

    def load(self, fault_id: str):
        row = self.load_all().where(F.col("fault_id") == fault_id).first()
        if row is None:
            raise KeyError(f"no sealed record {fault_id}")
        return row

    def list_ids(self) -> list[str]:
        return [r["fault_id"] for r in self.load_all().select("fault_id").collect()]  # faults are injected one by one

    def active(self) -> DataFrame:
        """Faults that have not ended."""
        return self.load_all().where("reverted_at is null")

    def window(self, fault_id: str) -> tuple[datetime, datetime | None]:
        row = self.load(fault_id)
        return row["injected_at"], row["reverted_at"]

    def _next(self) -> int:
        n = self._events().agg(F.max("seq")).first()[0]
        return 0 if n is None else n + 1

    def store(self, truth: DataFrame) -> None:
        """Seals the records of truth (the columns of TRUTH); a fault that is sealed already is refused."""
        if not truth.join(self.load_all().select("fault_id"), "fault_id", "left_semi").isEmpty():
            raise FileExistsError("a sealed record is not overwritten")
        self._append(truth, self._next())

    def mark_reverted(self, fault_id: str, at: datetime) -> None:
        if self.load(fault_id)["reverted_at"] is not None:
            raise ValueError(f"{fault_id} has ended already; correct_reverted() replaces a wrong time")
        self._append(self.load_all().where(F.col("fault_id") == fault_id).withColumn("reverted_at", F.lit(at).cast("timestamp")), self._next())

    def correct_reverted(self, fault_id: str, at: datetime, reason: str, now: datetime) -> None:
        if not reason.strip():
            raise ValueError("a correction names the evidence that it rests on")
        was = self.load(fault_id)["reverted_at"]
        if was is None:
            raise ValueError(f"{fault_id} has no end to correct; mark_reverted() sets it")
        entry = F.struct(*(F.lit(v).alias(k) for k, v in {"field": "reverted_at", "from": was.isoformat(), "to": at.isoformat(), "reason": reason.strip(), "corrected_at": now.isoformat()}.items()))
        row = self.load_all().where(F.col("fault_id") == fault_id)
        row = row.withColumns({"reverted_at": F.lit(at).cast("timestamp"), "corrections": F.concat(F.coalesce("corrections", F.array().cast("array<struct<field:string,`from`:string,`to`:string,reason:string,corrected_at:string>>")), F.array(entry))})
        self._append(row, self._next())

    def discard(self, fault_id: str) -> None:
        """Takes out a record of an injection that failed; the events stay in the folder."""
        self._append(self.load_all().where(F.col("fault_id") == fault_id).withColumn("discarded", F.lit(True)), self._next())
