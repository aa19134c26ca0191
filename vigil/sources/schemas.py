"""Declared schemas and natural keys of the datasets. What is appended is cast to these, so files of one dataset never disagree."""

from __future__ import annotations

from pyspark.sql import types as T

WORKSPACE = "workspace_id string, workspace_name string"

#: The columns of each dataset, and the columns that tell its facts apart.
DDL = {
    "items": f"{WORKSPACE}, item_id string, item_name string, item_type string",
    "job_runs": f"{WORKSPACE}, item_id string, item_name string, item_type string, run_id string, job_type string, invoke_type string, status string, start_time timestamp, end_time timestamp, duration_seconds double, failure_reason string",
    "datasets": f"{WORKSPACE}, dataset_id string, dataset_name string, configured_by string, is_refreshable boolean, storage_mode string",
    "refresh_runs": f"{WORKSPACE}, dataset_id string, dataset_name string, refresh_id string, request_id string, refresh_type string, status string, start_time timestamp, end_time timestamp, duration_seconds double, error string",
    "delta_commits": "workspace_name string, table_name string, version bigint, timestamp timestamp, operation string, rows_added bigint, metrics_rows bigint",
    "landing_files": "workspace_name string, source_name string, path string, exists boolean, size_bytes bigint, modified_at timestamp, data_rows bigint",
    "capacity_metrics": f"{WORKSPACE}, item_id string, item_name string, operation string, start_time timestamp, duration_seconds double, cu_seconds double, throttled boolean",
    "activity_events": f"{WORKSPACE}, activity_id string, user string, operation string, item_id string, item_name string, happened_at timestamp",
    "model_stats": f"{WORKSPACE}, dataset_id string, dataset_name string, table_name string, column_name string, measured_on date, row_count bigint, distinct_values bigint, size_bytes bigint",
    "incidents": (
        "incident_id string, detected_at timestamp, rule string, fault_class string, workspace string, item_name string, item_type string, severity string, summary string, occurrence_key string, origin string, measured_json string, "
        "diagnosis_cause string, diagnosis_reasoning string, diagnosis_confidence string, diagnosis_cited_json string, recommended_action string, diagnosis_source string, diagnosis_model string, fallback_reason string, diagnosed_at timestamp, "
        "proposal_target string, proposal_summary string, proposal_change string, proposal_rationale string, proposal_prevents string, proposal_risks string, proposal_confidence string, proposal_cited_json string, proposal_source string, proposal_model string, proposed_at timestamp, "
        "decision string, decided_by string, decided_at timestamp, reviewer_note string, verdict string, judged_by string, judged_at timestamp, verdict_note string, benchmark_ref string"
    ),
}
NATURAL_KEYS = {
    "items": ["item_id"],
    "job_runs": ["run_id"],
    "datasets": ["dataset_id"],
    "refresh_runs": ["dataset_id", "refresh_id"],
    "delta_commits": ["workspace_name", "table_name", "version"],
    "landing_files": ["source_name", "collected_at"],
    "capacity_metrics": ["item_id", "operation", "start_time"],
    "activity_events": ["activity_id"],
    "model_stats": ["dataset_id", "table_name", "column_name", "measured_on"],
    "incidents": ["incident_id"],
}


def declared(dataset: str) -> T.StructType:
    """The schema of a dataset, with the time of collection and the order of arrival that every one has; only those for a dataset that isn't declared."""
    own = T.StructType.fromDDL(DDL[dataset]) if dataset in DDL else T.StructType()
    return T.StructType([*own.fields, T.StructField("collected_at", T.TimestampType()), T.StructField("ingest_seq", T.LongType())])
