"""The incident store: sparse rows appended, latest known values read. Recording again changes no decision; an unknown id or word changes nothing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.latest import load as load_view
from vigil.operators.profile import columns_of
from vigil.sources.schemas import declared

DATASET = "incidents"
#: What a reviewer can decide, and what a diagnosis can be judged to be.
DECISIONS = ("pending", "approved", "rejected", "superseded")
VERDICTS = ("correct", "partial", "restatement", "incorrect", "abstained")


def rows(incidents: DataFrame, diagnoses: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """Incidents, and what was found and proposed about them, as rows of the store; diagnoses and proposals are by incident_id, in the store's columns."""
    out = incidents
    for other in (diagnoses, proposals):
        if other is not None:
            out = out.join(other, "incident_id", "left")
    return columns_of(out, declared(DATASET).names)


def record(store, incidents: DataFrame, diagnoses: DataFrame | None, proposals: DataFrame | None, now: datetime) -> int:
    return store.write(DATASET, rows(incidents, diagnoses, proposals), now)


def load(store) -> DataFrame:
    return load_view(store, DATASET)


def _known(store, incident_id: str) -> None:
    if store.read(DATASET).where(F.col("incident_id") == incident_id).isEmpty():
        raise KeyError(f"no incident {incident_id}")


def decide(store, incident_id: str, decision: str, by: str, note: str, now: datetime) -> None:
    if decision not in DECISIONS:
        raise ValueError(f"{decision} is none of {', '.join(DECISIONS)}")
    _known(store, incident_id)
    store.write(DATASET, [{"incident_id": incident_id, "decision": decision, "decided_by": by, "decided_at": now, "reviewer_note": note}], now)


def decide_all(store, decisions: DataFrame, now: datetime) -> int:
    """Records many decisions at once: incident_id, decision, decided_by, reviewer_note. An id that the store doesn't hold, or a word that is none, is an error, and nothing is written."""
    held = store.read(DATASET).select("incident_id").distinct().withColumn("__held", F.lit(True))
    checked = decisions.join(held, "incident_id", "left").where(F.col("__held").isNull() | ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)))
    wrong = checked.select("incident_id", "decision", "__held").limit(20).collect()
    if unknown := [r["incident_id"] for r in wrong if not r["__held"]]:
        raise KeyError(f"no incident {', '.join(map(str, unknown))}")
    if wrong:
        raise ValueError(f"{wrong[0]['decision']} is none of {', '.join(DECISIONS)}")
    return store.write(DATASET, decisions.select("incident_id", "decision", "decided_by", "reviewer_note").withColumn("decided_at", F.lit(now).cast("timestamp")), now)


def judge(store, incident_id: str, verdict: str, by: str, note: str, now: datetime) -> None:
    if verdict not in VERDICTS:
        raise ValueError(f"{verdict} is none of {', '.join(VERDICTS)}")
    _known(store, incident_id)
    store.write(DATASET, [{"incident_id": incident_id, "verdict": verdict, "judged_by": by, "judged_at": now, "verdict_note": note}], now)


def link_to_fault(store, incident_id: str, fault_id: str, now: datetime) -> None:
    _known(store, incident_id)
    store.write(DATASET, [{"incident_id": incident_id, "benchmark_ref": fault_id}], now)


def get(view: DataFrame, incident_id: str) -> DataFrame:
    """The one row of an incident."""
    row = view.where(F.col("incident_id") == incident_id)
    if row.isEmpty():
        raise KeyError(f"no incident {incident_id}")
    return row


def pending(view: DataFrame) -> DataFrame:
    """Incidents that nobody has decided on."""
    return view.where(F.coalesce("decision", F.lit("pending")) == "pending")


def reviewable(view: DataFrame) -> DataFrame:
    return view.where(F.col("proposal_target").isNotNull())


#: The names that the rules measure.
MEASURED = (
    "run_id", "run_started", "run_ended", "run_duration_seconds", "run_status", "expected_table", "rows_delivered", "rows_expected_minimum", "last_commit_to_table",
    "dataset", "last_collected_at", "evaluated_at", "gap_hours", "expected_every_minutes", "intervals_missed",
)


def measured(view: DataFrame, schema: T.StructType | None = None, names: list[str] | None = None) -> DataFrame:
    """view with the values of its measured_json as columns in its place, nested ones by dotted names. With names, or without anything the names that rules measure, every value is text; one that isn't there or isn't JSON
    is null. `measured_names` tells which there are. Nothing runs while this is built."""
    if "measured_json" not in view.columns:
        return view
    keep = [F.col(f"`{c}`") for c in view.columns if c != "measured_json"]
    if schema is None:
        value = lambda n: F.try_variant_get(F.col("__v"), "$" + "".join(f"['{part}']" for part in n.split(".")), "string").alias(n)
        return view.withColumn("__v", F.try_parse_json("measured_json")).select(*keep, *(value(n) for n in (MEASURED if names is None else names)))
    flat = []
    for f in schema:
        nested = f.dataType if isinstance(f.dataType, T.StructType) else []
        flat += [F.col("__m")[f.name][g.name].alias(f"{f.name}.{g.name}") for g in nested] or [F.col("__m")[f.name].alias(f.name)]
    return view.withColumn("__m", F.from_json("measured_json", schema)).select(*keep, *flat) if flat else view.select(*keep)


def measured_names(view: DataFrame, depth: int = 4) -> DataFrame:
    """name, kind, n: the dotted names that occur in measured_json, down to a depth, the type that all of their values fit, and in how many rows."""
    level = view.select(F.lit("").alias("name"), F.try_parse_json("measured_json").alias("v"))
    out = None
    for _ in range(depth):
        each = level.where(F.schema_of_variant("v").startswith("OBJECT")).lateralJoin(view.sparkSession.tvf.variant_explode(F.col("v").outer()))
        level = each.select(F.concat_ws(".", F.nullif("name", F.lit("")), "key").alias("name"), F.col("value").alias("v"))
        out = level if out is None else out.unionAll(level)
    inner = F.schema_of_variant("v").startswith("OBJECT")
    return out.where(~inner).groupBy("name").agg(F.schema_of_variant_agg("v").alias("kind"), F.count("*").alias("n"))


def summary(view: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """metric, value: how many incidents, how diagnosed, how many wait. queue: the rows whose decisions count as waiting, those of view if not given."""
    source, target = F.col("diagnosis_source"), F.col("proposal_target")
    counts = {
        "incidents": F.count(F.lit(1)), "diagnosed": F.count("diagnosis_cause"), "by_model": F.count_if(source == "model"), "abstained": F.count_if(source == "abstention"), "by_fallback": F.count_if(source == "fallback"),
        "proposed": F.count(target) - F.count_if(target == "none"), "no_change_warranted": F.count_if(target == "none"),
    }
    row = view.agg(*(v.alias(k) for k, v in counts.items()))
    wait = pending(view if queue is None else queue).agg(F.count(F.lit(1)).alias("pending"))
    names = [*counts, "pending"]
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))
    return row.crossJoin(F.broadcast(wait)).select(F.explode(pairs).alias("p")).select("p.*")  # two rows of one row


def as_text(view: DataFrame, columns: list[str], rows: int = 20) -> str:
    """The first rows of those columns that there are, for reading."""
    return columns_of(view, columns).limit(rows).toPandas().to_string(index=False)


def readable(view: DataFrame) -> DataFrame:
    """incident_id, incident, diagnosis, proposal: each as a line of text; a diagnosis or proposal that there isn't is null."""
    said = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    cited = lambda c: F.coalesce(F.array_join(F.from_json(F.col(c), "array<string>"), ", "), F.lit(""))
    incident = F.concat(F.lit("["), F.upper(said("severity")), F.lit("] "), said("rule"), F.lit(" | "), said("item_name"), F.lit(" | "), said("summary"))
    diagnosis = F.when(F.col("diagnosis_cause").isNotNull(), F.concat(said("diagnosis_cause"), F.lit(" ("), said("diagnosis_confidence"), F.lit(", "), said("diagnosis_source"), F.lit("; cites "), cited("diagnosis_cited_json"), F.lit(")")))
    proposal = F.when(F.col("proposal_target").isNotNull(), F.concat(said("proposal_target"), F.lit(": "), said("proposal_summary"), F.lit(" ("), said("proposal_confidence"), F.lit("; cites "), cited("proposal_cited_json"), F.lit(")")))
    return view.select("incident_id", incident.alias("incident"), diagnosis.alias("diagnosis"), proposal.alias("proposal"))
