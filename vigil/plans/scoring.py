"""Scoring against sealed faults: which incidents lie in a fault's window, how late the first came, how they were judged.

Verdicts on incidents of a fault and on others never share a denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalars import hours_between, parse_utc, rounded
from vigil.operators.intervals import in_windows, swept
from vigil.sources.seal import NotConfigured, Seal


def run_times(incidents: DataFrame) -> DataFrame:
    """incidents with run_time, when the incident's run started; null for those that aren't about a run."""
    return incidents.withColumn("run_time", parse_utc(F.get_json_object("measured_json", "$.run_started")))


def pairs(incidents: DataFrame, truth: DataFrame, now: Column) -> DataFrame:
    """fault_id, injected_at, incident_id, run_time of each incident within a fault's window; one of two faults counts for both."""
    p = run_times(incidents).select("incident_id", F.col("item_name").alias("target_item"), "run_time")
    met = in_windows(p, truth, "target_item", "run_time", "injected_at", "reverted_at", now.cast("timestamp"))
    return met.select("w.fault_id", "w.injected_at", "p.incident_id", "p.run_time")


def match(incidents: DataFrame, truth: DataFrame, now: Column) -> DataFrame:
    """fault_id, incident_ids (ordered) of every fault, also those without any."""
    found = pairs(incidents, truth, now).groupBy("fault_id").agg(F.array_sort(F.collect_set("incident_id")).alias("incident_ids"))
    none = F.array().cast("array<string>")
    return truth.select("fault_id").join(found, "fault_id", "left").select("fault_id", F.coalesce("incident_ids", none).alias("incident_ids"))


def met(incidents: DataFrame, truth: DataFrame, now: Column) -> DataFrame:
    """Incidents and the edges of faults' windows with what each meets, without pairs: see `swept`. An incident with no run time is in no window."""
    i = run_times(incidents).withColumn("target_item", F.col("item_name"))
    return swept(i, truth.select("fault_id", "target_item", "injected_at", "reverted_at"), "target_item", "run_time", "injected_at", F.coalesce("reverted_at", now.cast("timestamp")))


def unmatched(incidents: DataFrame, truth: DataFrame, now: Column) -> DataFrame:
    """The incidents in no fault's window."""
    return met(incidents, truth, now).where("side = 0 and open = 0").select("point.*").select(*incidents.columns)


def _first(now: Column) -> Column:
    """Hours from injection to the first incident of a window; null where that is after its end."""
    w, next_ = F.col("window"), F.col("next")
    return F.when((F.col("side") == 1) & (next_ <= F.coalesce(w["reverted_at"], now.cast("timestamp"))), hours_between(w["injected_at"], next_))


def latency(incidents: DataFrame, truth: DataFrame, now: Column) -> DataFrame:
    """fault_id, n, latency_hours (from injection to the first of its incidents, unrounded; null without) of every fault."""
    return _latency(incidents, truth, now).select("fault_id", "n", "latency_hours")


def _latency(incidents: DataFrame, truth: DataFrame, now: Column) -> DataFrame:
    sign = F.when(F.col("side") == 2, F.col("seen")).otherwise(-F.col("seen"))
    ends = met(incidents, truth, now).where("side > 0").select("window.*", sign.alias("s"), _first(now).alias("h"))
    return ends.groupBy("fault_id").agg(F.sum("s").alias("n"), F.min("h").alias("latency_hours"), F.min("injected_at").alias("injected_at"), F.min("reverted_at").alias("reverted_at"))


def require(seal: Seal) -> None:
    if not seal.exists():
        raise NotConfigured(f"no sealed ground truth in {seal.path}: zeros would read as measurements")


#: What is there also where it is zero.
COUNTED = ("faults_sealed", "faults_detected", "faults_missed", "faults_still_live", "incidents_matched", "incidents_total", "incidents_unmatched", "judged_against_seal", "judged_without_seal", "diagnosed_awaiting_verdict", "undiagnosed")


def results(incidents: DataFrame, truth: DataFrame, now: Column) -> DataFrame:
    """metric, value (double, null where nothing was measured): faults, incidents, latencies, and counts of sources, verdicts, decisions, proposals.

    One pass: each incident and edge of a window adds to the metrics that it is of. Latencies are counted by their hundredths of an hour, so what comes together at the end is
    the metrics and those hundredths, not faults.
    """
    i, side = F.col("point"), F.col("side")
    inside, late = F.col("open") > 0, rounded(_first(now), 2)
    add = lambda name, when, value=1: F.when(when, F.struct((F.lit(name) if isinstance(name, str) else name).alias("metric"), F.lit(None).cast("double").alias("hours"), (F.lit(value) if isinstance(value, int) else value).cast("bigint").alias("n")))
    of = lambda prefix, c, when=F.lit(True): add(F.concat(F.lit(prefix + "_"), i[c].cast("string")), i[c].isNotNull() & when)
    judged, cause = i["verdict"].isNotNull(), i["diagnosis_cause"].isNotNull()
    of_incident = [
        add("incidents_total", F.lit(True)), add("incidents_unmatched", ~inside), add("judged_against_seal", inside & judged), add("judged_without_seal", ~inside & judged), add("diagnosed_awaiting_verdict", cause & ~judged), add("undiagnosed", ~cause),
        of("diagnosis", "diagnosis_source"), of("verdict", "verdict", inside), of("unsealed_verdict", "verdict", ~inside), of("decision", "decision"), of("proposal", "proposal_target"),
    ]
    of_start = [
        add("faults_sealed", F.lit(True)), add("faults_detected", late.isNotNull()), add("faults_missed", late.isNull()), add("faults_still_live", F.col("window.reverted_at").isNull()), add("incidents_matched", F.lit(True), -F.col("seen")),
        F.when(late.isNotNull(), F.struct(F.lit("latency").alias("metric"), late.alias("hours"), F.lit(1).cast("bigint").alias("n"))),
    ]
    adds = F.when(side == 0, F.array_compact(F.array(*of_incident))).when(side == 1, F.array_compact(F.array(*of_start))).otherwise(F.array(add("incidents_matched", F.lit(True), F.col("seen"))))
    long = met(incidents, truth, now).select(F.explode(adds).alias("a")).select("a.*")
    sums = long.groupBy("metric", "hours").agg(F.sum("n").alias("n"))
    is_late = F.col("metric") == "latency"
    row = sums.agg(F.collect_list(F.when(~is_late, F.struct("metric", "n"))).alias("counts"), F.sort_array(F.collect_list(F.when(is_late, F.struct("hours", "n")))).alias("late"))
    known = F.map_from_entries("counts")
    fixed = F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(known[m], F.lit(0)).cast("double").alias("value")) for m in COUNTED))
    other = F.transform(F.filter("counts", lambda x: ~x["metric"].isin(*COUNTED)), lambda x: F.struct(x["metric"].alias("metric"), x["n"].cast("double").alias("value")))
    # the value in the middle, of two the upper: the first whose running count goes beyond half
    whole = F.aggregate("late", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    before = F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(None).cast("double").alias("m"))
    median = F.aggregate("late", before, lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.coalesce(a["m"], F.when(a["c"] + x["n"] > F.floor(whole / 2), x["hours"])).alias("m")))["m"]
    hours = F.array(F.struct(F.lit("latency_hours_median").alias("metric"), median.alias("value")), F.struct(F.lit("latency_hours_worst").alias("metric"), F.get("late", F.size("late") - 1)["hours"].alias("value")))
    return row.select(F.explode(F.concat(fixed, other, hours)).alias("p")).select("p.*")


def table(incidents: DataFrame, truth: DataFrame, now: Column) -> DataFrame:
    """fault_id, incidents, latency_h (text, a dash without), window of every fault."""
    t = _latency(incidents, truth, now)
    day = lambda c: F.date_format(c, "dd MMM HH:mm")
    window = F.concat(day("injected_at"), F.lit(" to "), F.coalesce(day("reverted_at"), F.lit("LIVE")))
    return t.select("fault_id", F.col("n").alias("incidents"), F.when(F.col("latency_hours").isNotNull(), F.format_string("%.2f", rounded(F.col("latency_hours"), 2))).otherwise("—").alias("latency_h"), window.alias("window")).orderBy("fault_id")


def report(seal: Seal, incidents: DataFrame, now: Column, backend: str) -> DataFrame:
    """results() of a seal, which must hold something, with the seal's place and the store's kind as text beside each value."""
    require(seal)
    return results(incidents, seal.load_all(), now).select("metric", "value", F.lit(seal.path).alias("seal_path"), F.lit(backend).alias("backend"))
