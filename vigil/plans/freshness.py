"""Telemetry that has stopped arriving: how many of its intervals a dataset has missed. One outage has one incident: it is known by when the silence began."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.scalars import as_json, incident_id, iso, micros, one_digit, rounded, severity

RULE, FAULT_CLASS = "collection_gap", "collection_gap"
#: Missed intervals from which a dataset is late.
LATE = 2.0


@dataclass(frozen=True)
class CollectionExpectation:
    dataset: str
    every_minutes: int
    workspace: str = ""


def expectations(spark: SparkSession, given: list[CollectionExpectation]) -> DataFrame:
    return spark.createDataFrame([(e.dataset, e.every_minutes, e.workspace) for e in given], "dataset string, every_minutes bigint, workspace string")


def gaps(last_collected: DataFrame, expected: DataFrame, now: Column) -> DataFrame:
    """expected with seen, gap_hours and intervals_missed; null where a dataset was never collected."""
    us = micros(now.cast("timestamp")) - micros("seen")
    return expected.join(last_collected.select("dataset", "seen"), "dataset", "left").withColumns({"gap_hours": us / F.lit(3.6e9), "intervals_missed": us / (F.col("every_minutes") * F.lit(60_000_000))})


def detect(last_collected: DataFrame, expected: DataFrame, now: Column, detected_at: Column | None = None) -> DataFrame:
    """The incidents, as rows of `incidents`. last_collected: dataset, seen; a dataset that is missing there was never collected."""
    g = gaps(last_collected, expected, now).where(F.col("seen").isNull() | (F.col("intervals_missed") >= LATE))
    never = F.col("seen").isNull()
    occurrence = F.concat("dataset", F.lit("|"), F.coalesce(iso("seen"), F.lit("never")))
    late = F.concat(
        "dataset", F.lit(" was last collected "), one_digit(F.col("gap_hours")), F.lit(" hours ago, against an expected every "), F.col("every_minutes").cast("string"),
        F.lit(" minutes. Any detection result covering this period is measured against stale evidence."),
    )
    none = F.concat("dataset", F.lit(" has never been collected. Every rule that reads it is reporting on an empty table, which looks identical to a healthy estate."))
    measured = as_json(
        dataset=F.col("dataset"), last_collected_at=iso("seen"), evaluated_at=iso(now.cast("timestamp")), gap_hours=rounded(F.col("gap_hours"), 2), expected_every_minutes=F.col("every_minutes"), intervals_missed=rounded(F.col("intervals_missed"), 1)
    )
    return g.select(
        incident_id(F.lit(RULE), F.col("workspace"), F.col("dataset"), occurrence).alias("incident_id"), (now if detected_at is None else detected_at).cast("timestamp").alias("detected_at"), F.lit(RULE).alias("rule"), F.lit(FAULT_CLASS).alias("fault_class"),
        "workspace", F.col("dataset").alias("item_name"), F.lit("Telemetry").alias("item_type"), F.when(never, "high").otherwise(severity(F.col("intervals_missed"))).alias("severity"), F.when(never, none).otherwise(late).alias("summary"),
        occurrence.alias("occurrence_key"), F.lit("discovered").alias("origin"), measured.alias("measured_json"),
    )
