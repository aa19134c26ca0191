"""Evidence packs of all incidents at once: facts as rows, from grouped baselines, the source's last sample before the run, and overlapping runs.

A fact that was not measured is a null, which reads `unknown`; how much was measured has a namespace of its own, `coverage.`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalars import hours_between, iso, micros, not_equal, number, parse_utc, rounded
from vigil.operators.intervals import as_of, overlap_counts, running_totals
from vigil.operators.order import quantiles

#: Every key of a pack in order and its type; then what it is, in words of this module.
FACTS = (
    ("run.id", "string", "id of the flagged run"),
    ("run.started", "string", "start of the run in UTC"),
    ("run.ended", "string", "end of the run in UTC"),
    ("run.duration_seconds", "double", "length of the run in seconds"),
    ("run.status", "string", "outcome that the platform gave the run"),
    ("run.rows_delivered", "bigint", "rows that reached the target table while the run was on"),
    ("expectation.minimum_rows", "bigint", "fewest rows that the run was to deliver"),
    ("expectation.target_table", "string", "table that the pipeline is to write"),
    ("pipeline.runs_observed", "bigint", "runs of the pipeline on record"),
    ("pipeline.duration_median_seconds", "double", "median length of the pipeline's runs"),
    ("pipeline.duration_min_seconds", "double", "length of its shortest run"),
    ("pipeline.duration_max_seconds", "double", "length of its longest run"),
    ("pipeline.failed_runs", "bigint", "its runs that ended in anything but success"),
    ("table.commits_observed", "bigint", "commits to the table on record"),
    ("table.zero_row_commits", "bigint", "of these, those without a new row"),
    ("table.uncounted_commits", "bigint", "of these, those of unknown size"),
    ("table.typical_delivery_rows", "bigint", "median rows of a commit with any"),
    ("table.deliveries_observed", "bigint", "commits with any rows"),
    ("table.last_delivery_at", "string", "time of the last commit with rows"),
    ("table.hours_since_last_delivery", "double", "hours since then"),
    ("coverage.source_measured", "boolean", "is there any sample of the source up to the run's end"),
    ("coverage.source_samples", "bigint", "number of such samples"),
    ("source.name", "string", "source file of the newest such sample"),
    ("source.sampled_at", "string", "time of that sample"),
    ("source.exists", "boolean", "was the file there"),
    ("source.data_rows", "bigint", "its rows below the header"),
    ("source.size_bytes", "bigint", "its size in bytes"),
    ("source.modified_at", "string", "time of its last change"),
    ("source.hours_old_at_run", "double", "its age in hours when the run began"),
    ("estate.concurrent_runs", "bigint", "runs of other items at the same time"),
)
MEASURED = "struct<run_id:string,run_started:string,run_ended:string,run_duration_seconds:double,run_status:string,expected_table:string,rows_delivered:bigint,rows_expected_minimum:bigint>"


def pipeline_baseline(runs: DataFrame, spread: bool = False) -> DataFrame:
    """item_name, runs_observed, exact median, least and most of the durations, failed_runs (a null status has failed). spread: the medians by places in range partitions, for items with more distinct values than a task should hold."""
    d = number(F.col("duration_seconds").cast("string"))
    counts = [F.count("*").alias("runs_observed"), F.median(d).alias("duration_median"), F.min(d).alias("duration_min"), F.max(d).alias("duration_max"), F.count_if(not_equal(F.col("status"), "Completed")).alias("failed_runs")]
    if not spread:
        return runs.groupBy("item_name").agg(*counts)
    out = runs.groupBy("item_name").agg(counts[0], *counts[2:])
    return _joined(out, quantiles(runs, ["item_name"], d, {"duration_median": 0.5}), "item_name").select("item_name", "runs_observed", "duration_median", "duration_min", "duration_max", "failed_runs")


def table_baseline(commits: DataFrame, spread: bool = False) -> DataFrame:
    """table_name, commits_observed, zero_row_commits, uncounted_commits, typical_delivery_rows (the median's whole part), deliveries_observed, last_delivery. spread: as above."""
    r = F.col("rows_added")
    counts = [F.count("*").alias("commits_observed"), F.count_if(r == 0).alias("zero_row_commits"), F.count_if(r.isNull()).alias("uncounted_commits")]
    rest = [F.count_if(r > 0).alias("deliveries_observed"), F.max(F.when(r > 0, F.col("timestamp"))).alias("last_delivery")]
    if not spread:
        return commits.groupBy("table_name").agg(*counts, F.median(F.when(r > 0, r)).cast("bigint").alias("typical_delivery_rows"), *rest)
    typical = quantiles(commits, ["table_name"], F.when(r > 0, r), {"typical_delivery_rows": 0.5}).withColumn("typical_delivery_rows", F.col("typical_delivery_rows").cast("bigint"))
    return _joined(commits.groupBy("table_name").agg(*counts, *rest), typical, "table_name").select("table_name", "commits_observed", "zero_row_commits", "uncounted_commits", "typical_delivery_rows", "deliveries_observed", "last_delivery")


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of the right row of the same key, null keys included."""
    return left.join(right.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def facts(incidents: DataFrame, runs: DataFrame, commits: DataFrame, landing: DataFrame | None, now: Column, by_source: dict[str, str] | None = None) -> DataFrame:
    """One row an incident: incident_id and a column of each fact, null for one that its pack does not hold or that is unknown, and `held`, the keys that it holds.

    runs, commits and landing are views of latest known values. by_source maps a pipeline to the source that it reads; without, the newest
    sample of any source counts.
    """
    m = F.from_json("measured_json", MEASURED)
    i = incidents.select("incident_id", "item_name", m.alias("m")).select("incident_id", "item_name", "m.*")
    i = i.withColumns({"started": parse_utc(F.col("run_started")), "ended": parse_utc(F.col("run_ended"))})
    span = i.select("incident_id", "item_name", "started", "ended")
    i = i.join(pipeline_baseline(runs), "item_name", "left").join(table_baseline(commits).withColumnRenamed("table_name", "expected_table"), "expected_table", "left")
    if landing is None:
        kind = "struct<source_name:string,exists:boolean,data_rows:bigint,size_bytes:bigint,modified_at:timestamp,collected_at:timestamp>"
        i = i.withColumns({"sample": F.lit(None).cast(kind), "samples": F.lit(0).cast("bigint")})
    else:
        sample = F.struct("source_name", "exists", "data_rows", "size_bytes", "modified_at", "collected_at")
        by = [] if by_source is None else ["k"]
        of = F.lit("") if by_source is None else F.coalesce(F.create_map(*(F.lit(x) for pair in by_source.items() for x in pair))[F.col("item_name")], F.lit(""))
        taken = landing.where(F.col("collected_at").isNotNull()).select(F.col("source_name").alias("k"), F.col("collected_at").alias("at"), sample.alias("sample"))
        asked = span.select("incident_id", of.alias("k"), "ended")
        # the newest sample by the run's end, and how many there were by then
        newest = as_of(asked.select("incident_id", *by, "ended"), taken.select(*by, "at", "sample"), by, "ended", "at", ["sample"]).select("incident_id", "sample")
        many = running_totals(taken.select(*by, micros("at").alias("at"), F.lit(0).alias("ord"), F.lit(1).alias("samples")), asked.select("incident_id", *by, micros("ended").alias("at"), F.lit(1).alias("ord")), by, ["samples"]).select("incident_id", "samples")
        i = i.join(newest, "incident_id", "left").join(many, "incident_id", "left")
    spans = span.select("incident_id", F.col("item_name").alias("item"), F.col("started").alias("start"), F.col("ended").alias("end"))
    others = runs.select(F.col("item_name").alias("item"), F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    beside = overlap_counts(spans, others, "incident_id").withColumnRenamed("id", "incident_id").withColumnRenamed("n", "beside")
    i = i.join(beside, "incident_id", "left")
    seen, own, timed = F.coalesce("samples", F.lit(0)), F.coalesce("runs_observed", F.lit(0)), F.col("started").isNotNull() & F.col("ended").isNotNull()
    given = F.coalesce("commits_observed", F.lit(0))
    got = F.col("sample").isNotNull()
    measured_at_all = F.lit(landing is None) | F.col("ended").isNotNull()
    values = {
        "run.id": (F.col("run_id"), F.lit(True)), "run.started": (F.col("run_started"), F.lit(True)), "run.ended": (F.col("run_ended"), F.lit(True)), "run.duration_seconds": (F.col("run_duration_seconds"), F.lit(True)),
        "run.status": (F.col("run_status"), F.lit(True)), "run.rows_delivered": (F.col("rows_delivered"), F.lit(True)), "expectation.minimum_rows": (F.col("rows_expected_minimum"), F.lit(True)), "expectation.target_table": (F.col("expected_table"), F.lit(True)),
        "pipeline.runs_observed": (own, F.lit(True)),
        "pipeline.duration_median_seconds": (rounded(F.col("duration_median"), 1), F.col("duration_median").isNotNull()), "pipeline.duration_min_seconds": (rounded(F.col("duration_min"), 1), F.col("duration_min").isNotNull()), "pipeline.duration_max_seconds": (rounded(F.col("duration_max"), 1), F.col("duration_max").isNotNull()),
        "pipeline.failed_runs": (F.col("failed_runs"), own > 0),
        "table.commits_observed": (given, F.lit(True)), "table.zero_row_commits": (F.col("zero_row_commits"), given > 0), "table.uncounted_commits": (F.col("uncounted_commits"), given > 0),
        "table.typical_delivery_rows": (F.col("typical_delivery_rows"), F.col("deliveries_observed") > 0), "table.deliveries_observed": (F.col("deliveries_observed"), F.col("deliveries_observed") > 0),
        "table.last_delivery_at": (iso("last_delivery"), F.col("last_delivery").isNotNull()), "table.hours_since_last_delivery": (rounded(hours_between(F.col("last_delivery"), now.cast("timestamp")), 1), F.col("last_delivery").isNotNull()),
        "coverage.source_measured": (seen > 0, measured_at_all), "coverage.source_samples": (seen, measured_at_all),
        "source.name": (F.col("sample.source_name"), got), "source.sampled_at": (iso(F.col("sample.collected_at")), got), "source.exists": (F.coalesce("sample.exists", F.lit(False)), got), "source.data_rows": (F.col("sample.data_rows"), got),
        "source.size_bytes": (F.col("sample.size_bytes"), got), "source.modified_at": (iso(F.col("sample.modified_at")), got),
        "source.hours_old_at_run": (rounded(hours_between(F.col("sample.modified_at"), F.col("started")), 1), got & F.col("sample.modified_at").isNotNull() & F.col("started").isNotNull()),
        "estate.concurrent_runs": (F.when(timed, F.col("beside")), F.lit(True)),
    }
    held = F.array_compact(F.array(*(F.when(F.coalesce(values[k][1], F.lit(False)), F.lit(k)) for k, _, _ in FACTS)))
    return i.select("incident_id", *(F.when(values[k][1], values[k][0]).cast(kind).alias(k) for k, kind, _ in FACTS), held.alias("held"))


def pack(wide: DataFrame) -> DataFrame:
    """incident_id, ord, key, value (text), value_type, label: a row a fact that a pack holds."""
    rows = F.array(*(F.struct(F.lit(n).alias("ord"), F.lit(k).alias("key"), _text(F.col(f"`{k}`"), kind).alias("value"), F.lit(kind).alias("value_type"), F.lit(label).alias("label")) for n, (k, kind, label) in enumerate(FACTS)))
    long = wide.select("incident_id", "held", F.explode(rows).alias("f")).select("incident_id", "held", "f.*")
    return long.where(F.array_contains("held", F.col("key"))).drop("held")


def _text(value: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.when(value, "True").when(~value, "False")
    return value.cast("string")


def prompts(packs: DataFrame) -> DataFrame:
    """incident_id, prompt: a line a fact, in order, with its label."""
    line = F.concat("key", F.lit(" = "), F.coalesce("value", F.lit("unknown")), F.lit("   ("), "label", F.lit(")"))
    return packs.groupBy("incident_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))


def keys(packs: DataFrame) -> DataFrame:
    """incident_id, available: the keys of each pack, which are what may be cited."""
    return packs.groupBy("incident_id").agg(F.collect_set("key").alias("available"))
