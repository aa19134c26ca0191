"""Runs that reported success and delivered too few rows.

One plan: eligible runs meet their expectations; what commits to the table added in the run's interval, widened by the skew
between clocks, is the difference of running totals at its ends, so that no run meets all commits of its table. A commit whose rows are unknown makes the run's delivery unknown, and no
incident; a run without any commit delivered nothing, and is one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.scalars import as_json, incident_id, iso, rounded, thousands, whole_seconds
from vigil.operators.intervals import interval_totals

RULE, FAULT_CLASS = "silent_zero_row", "silent_zero_row"
SKEW = "90 seconds"
EXPECTATIONS = "pipeline string, table string, workspace string, minimum_rows bigint"


@dataclass(frozen=True)
class WriteExpectation:
    pipeline: str
    table: str
    workspace: str
    minimum_rows: int = 1


def expectations(spark: SparkSession, given: list[WriteExpectation]) -> DataFrame:
    return spark.createDataFrame([(e.pipeline, e.table, e.workspace, e.minimum_rows) for e in given], EXPECTATIONS)


def eligible(runs: DataFrame, cutoff: Column) -> DataFrame:
    """Runs that completed, whose times are known, that ended before the cutoff."""
    return runs.where((F.col("status") == "Completed") & F.col("start_time").isNotNull() & F.col("end_time").isNotNull() & (F.col("end_time") < cutoff))


def deliveries(runs: DataFrame, commits: DataFrame, expected: DataFrame, cutoff: Column, skew: str = SKEW, strict_workspace: bool = False) -> DataFrame:
    """A row a judged run and expectation, with rows_delivered: null if unknown. strict_workspace: only the expectation's own workspace counts."""
    judged = eligible(runs, cutoff).select("run_id", "item_name", "status", "start_time", "end_time", "duration_seconds", *(["workspace_name"] if strict_workspace else []))
    # the expectations are configuration: a row a pipeline and table
    e = expected.select("pipeline", F.col("table").alias("expected_table"), F.col("workspace").alias("expected_workspace"), "minimum_rows")
    cond = (F.col("item_name") == F.col("pipeline")) & (F.col("workspace_name") == F.col("expected_workspace") if strict_workspace else F.lit(True))
    asked = judged.join(e, cond)
    by = ["expected_table", *(["expected_workspace"] if strict_workspace else [])]
    c = commits.select(F.col("table_name").alias("expected_table"), *([F.col("workspace_name").alias("expected_workspace")] if strict_workspace else []), "timestamp", F.col("rows_added").alias("added"), F.col("rows_added").isNull().cast("int").alias("unknown"))
    keys = ["run_id", "pipeline", "expected_table", "expected_workspace", "minimum_rows", "status", "start_time", "end_time", "duration_seconds"]
    spans = asked.select(*keys, (F.col("start_time") - F.expr(f"INTERVAL {skew}")).alias("__from"), (F.col("end_time") + F.expr(f"INTERVAL {skew}")).alias("__to"))
    met = interval_totals(c, spans, by, "timestamp", "__from", "__to", ["added", "unknown"])
    return met.withColumn("rows_delivered", F.when(F.col("unknown") == 0, F.col("added"))).drop("added", "unknown", "__from", "__to")


def detect(runs: DataFrame, commits: DataFrame, expected: DataFrame, cutoff: Column, detected_at: Column, skew: str = SKEW, strict_workspace: bool = False) -> DataFrame:
    """The incidents, as rows of `incidents`; one for each run and expectation, however often detection is repeated."""
    short = deliveries(runs, commits, expected, cutoff, skew, strict_workspace).where(F.col("rows_delivered") < F.col("minimum_rows"))
    last = commits.groupBy(F.col("table_name").alias("expected_table")).agg(F.max("timestamp").alias("last_commit"))
    d = short.join(last, "expected_table", "left")
    took = F.when(F.col("duration_seconds").isNotNull(), F.concat(F.lit(" in "), whole_seconds(F.col("duration_seconds")), F.lit("s"))).otherwise("")
    nothing = F.concat(F.lit("Run completed"), took, F.lit(" but wrote no rows to "), "expected_table", F.lit(". Downstream data is unchanged and therefore stale."))
    little = F.concat(F.lit("Run completed"), took, F.lit(" and wrote only "), thousands(F.col("rows_delivered")), F.lit(" rows to "), "expected_table", F.lit(", below the expected "), thousands(F.col("minimum_rows")), F.lit(". Delivery is partial."))
    measured = as_json(
        run_id=F.col("run_id"), run_started=iso("start_time"), run_ended=iso("end_time"), run_duration_seconds=rounded(F.col("duration_seconds"), 2), run_status=F.col("status"), expected_table=F.col("expected_table"),
        rows_delivered=F.col("rows_delivered"), rows_expected_minimum=F.col("minimum_rows"), last_commit_to_table=iso("last_commit"),
    )
    return d.select(
        incident_id(F.lit(RULE), F.col("expected_workspace"), F.col("pipeline"), F.col("run_id")).alias("incident_id"), detected_at.cast("timestamp").alias("detected_at"), F.lit(RULE).alias("rule"), F.lit(FAULT_CLASS).alias("fault_class"),
        F.col("expected_workspace").alias("workspace"), F.col("pipeline").alias("item_name"), F.lit("DataPipeline").alias("item_type"), F.lit("high").alias("severity"), F.when(F.col("rows_delivered") == 0, nothing).otherwise(little).alias("summary"),
        F.col("run_id").alias("occurrence_key"), F.lit("discovered").alias("origin"), measured.alias("measured_json"),
    )


def unresolved(runs: DataFrame, commits: DataFrame, expected: DataFrame) -> DataFrame:
    """kind, name: pipelines and tables of the expectations that no telemetry names."""
    from vigil.operators.profile import not_found

    a = not_found(expected.select("pipeline"), runs, "pipeline", "item_name").select(F.lit("pipeline").alias("kind"), F.col("pipeline").alias("name"))
    b = not_found(expected.select("table"), commits, "table", "table_name").select(F.lit("table").alias("kind"), F.col("table").alias("name"))
    return a.union(b).distinct()
