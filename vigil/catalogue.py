"""The queries over the provided tables, by name, and their SQL. Event types stand in for telemetry: purchases are runs, clicks commits, views samples of a source, errors incidents, signups faults."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from vigil.functions.scalars import as_utc, basename, micros, narrowed, parent, rounded, short_name, weekday, widened
from vigil.operators import extras, intervals, latest, order, profile, versions
from vigil.plans import claims, evidence, freshness, incidents, scoring, silent_delivery
from vigil.sources import store, wire
from vigil.sources.shared import shared_dir, written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, d, name):
    return as_utc(spark.read.parquet(f"{d}/{name}.parquet"))


# ---- stand-ins ----


def observations(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("value") >= 20, F.col("value")).alias("value"), "props", F.col("ts").alias("collected_at"))


def runs(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    end = F.col("ts") + F.expr("INTERVAL 12 HOURS")
    return e.select(
        F.lit("w").alias("workspace_name"), F.col("user_id").cast("string").alias("item_name"), F.col("event_id").cast("string").alias("run_id"), F.when(F.col("value") < 3, "Failed").when(F.col("value") >= 5, "Completed").alias("status"),
        F.col("ts").alias("start_time"), end.alias("end_time"), F.when(F.col("value") >= 10, F.lit(43200.0)).alias("duration_seconds"),
    )


def commits(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    rows = F.when(F.col("value") < 5, None).when(F.col("value") < 20, 0).otherwise(F.floor("value")).cast("bigint")
    return e.select(F.lit("w").alias("workspace_name"), F.col("user_id").cast("string").alias("table_name"), F.col("event_id").alias("version"), F.col("ts").alias("timestamp"), rows.alias("rows_added"), F.col("ts").alias("collected_at"))


def expected(spark, d):
    """Each pipeline is to write to the table of its own name."""
    return runs(spark, d).select(F.col("item_name").alias("pipeline"), F.col("item_name").alias("table"), F.lit("w").alias("workspace"), F.lit(20).cast("bigint").alias("minimum_rows")).distinct()


def cutoff(spark, d):
    c = latest.complete_until(commits(spark, d), None)
    return F.lit(c.first()["cutoff"])  # one row


def found(spark, d):
    return silent_delivery.detect(runs(spark, d), commits(spark, d), expected(spark, d), cutoff(spark, d), F.lit("2024-02-01 00:00:00"))


def faults(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'")
    return e.select(F.col("event_id").cast("string").alias("fault_id"), F.col("user_id").cast("string").alias("target_item"), F.col("ts").alias("injected_at"), F.when(F.col("event_id") % 20 == 0, F.col("ts") + F.expr("INTERVAL 120 HOURS")).alias("reverted_at"))


def errors(spark, d):
    """Errors as incidents, with what a reviewer might have recorded by their number."""
    e = table(spark, d, "events").where("event_type = 'error'")
    n = F.col("event_id")
    pick = lambda mod, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (n % mod + 1).cast("int"))
    return e.select(
        n.cast("string").alias("incident_id"), F.col("user_id").cast("string").alias("item_name"), F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("run_started"))).alias("measured_json"),
        pick(3, "cause", None, "undetermined").alias("diagnosis_cause"), pick(3, "model", None, "abstention").alias("diagnosis_source"), pick(5, "correct", None, "partial", None, "incorrect").alias("verdict"),
        pick(4, None, "pending", "approved", "rejected").alias("decision"), pick(3, "pipeline", "none", None).alias("proposal_target"),
    )


def now(spark, d):
    return F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0])  # one row


# the same in SQL
_RUNS = """runs AS (SELECT CAST(user_id AS VARCHAR) AS item_name, CAST(event_id AS VARCHAR) AS run_id, CASE WHEN value < 3 THEN 'Failed' WHEN value >= 5 THEN 'Completed' END AS status, ts AS start_time, ts + INTERVAL 12 HOUR AS end_time,
  CASE WHEN value >= 10 THEN 43200.0::DOUBLE END AS duration_seconds FROM events WHERE event_type = 'purchase')"""
_COMMITS = """commits AS (SELECT CAST(user_id AS VARCHAR) AS table_name, event_id AS version, ts AS "timestamp", CAST(CASE WHEN value < 5 THEN NULL WHEN value < 20 THEN 0 ELSE floor(value) END AS BIGINT) AS rows_added FROM events WHERE event_type = 'click')"""
_FAULTS = """faults AS (SELECT CAST(event_id AS VARCHAR) AS fault_id, CAST(user_id AS VARCHAR) AS target_item, ts AS injected_at, CASE WHEN event_id % 20 = 0 THEN ts + INTERVAL 120 HOUR END AS reverted_at FROM events WHERE event_type = 'signup')"""
_ERRORS = """incidents AS (SELECT CAST(event_id AS VARCHAR) AS incident_id, CAST(user_id AS VARCHAR) AS item_name, ts AS run_time, ['cause', NULL, 'undetermined'][event_id % 3 + 1] AS diagnosis_cause, ['model', NULL, 'abstention'][event_id % 3 + 1] AS diagnosis_source,
  ['correct', NULL, 'partial', NULL, 'incorrect'][event_id % 5 + 1] AS verdict, [NULL, 'pending', 'approved', 'rejected'][event_id % 4 + 1] AS decision, ['pipeline', 'none', NULL][event_id % 3 + 1] AS proposal_target FROM events WHERE event_type = 'error')"""
def _even(us: str, unit: int) -> str:
    """SQL of a number of microseconds in units, rounded half to even, in whole numbers."""
    return f"(({us}) // {unit} + CASE WHEN 2 * (({us}) % {unit}) > {unit} OR 2 * (({us}) % {unit}) = {unit} AND (({us}) // {unit}) % 2 = 1 THEN 1 ELSE 0 END)"


def _iso(ts: str) -> str:
    return f"(CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00')"


_HUNDREDTHS = _even("min(epoch_us(p.run_time) - epoch_us(p.injected_at))", 36_000_000)
_PAIRS = """pairs AS (SELECT f.fault_id, f.injected_at, i.incident_id, i.run_time FROM faults f JOIN incidents i ON i.item_name = f.target_item AND i.run_time >= f.injected_at AND i.run_time <= coalesce(f.reverted_at, (SELECT max(ts) FROM events)))"""
_DELIVERED = f"""{_RUNS}, {_COMMITS}, e AS (SELECT DISTINCT item_name AS pipeline FROM runs), cut AS (SELECT max("timestamp") - INTERVAL 10 MINUTE AS c FROM commits),
j AS (SELECT r.run_id, r.item_name, r.start_time, r.end_time, r.duration_seconds, count(c.table_name) AS n, count(*) FILTER (c.table_name IS NOT NULL AND c.rows_added IS NULL) AS unknown, sum(c.rows_added) AS added
  FROM runs r JOIN e ON r.item_name = e.pipeline LEFT JOIN commits c ON c.table_name = e.pipeline AND c."timestamp" >= r.start_time - INTERVAL 90 SECOND AND c."timestamp" <= r.end_time + INTERVAL 90 SECOND
  WHERE r.status = 'Completed' AND r.end_time < (SELECT c FROM cut) GROUP BY ALL),
del AS (SELECT *, CASE WHEN unknown > 0 THEN NULL ELSE CAST(coalesce(added, 0) AS BIGINT) END AS rows_delivered FROM j)"""


@query("""SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) FILTER (value >= 20) AS value, arg_max(props, ts) AS props, epoch_us(max(ts)) AS seen_us FROM events GROUP BY ALL""")
def latest_known(spark, d):
    return latest.latest_known(observations(spark, d), ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value", "props", micros("collected_at").alias("seen_us"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def newest_row(spark, d):
    e = table(spark, d, "events").withColumn("ingest_seq", F.col("event_id"))
    return latest.newest_row(e, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


@query(f"""WITH {_DELIVERED} SELECT 'INC-' || substr(sha1('silent_zero_row|w|' || item_name || '|' || run_id), 1, 10) AS incident_id, item_name, run_id AS occurrence_key, rows_delivered, epoch_us(start_time) AS started_us,
  'Run completed' || CASE WHEN duration_seconds IS NULL THEN '' ELSE ' in ' || CAST(CAST(duration_seconds AS BIGINT) AS VARCHAR) || 's' END || CASE WHEN rows_delivered = 0 THEN ' but wrote no rows to ' || item_name || '. Downstream data is unchanged and therefore stale.'
  ELSE ' and wrote only ' || rows_delivered || ' rows to ' || item_name || ', below the expected 20. Delivery is partial.' END AS summary FROM del WHERE rows_delivered < 20""")
def silent_delivery_incidents(spark, d):
    m = F.from_json("measured_json", "rows_delivered bigint, run_started timestamp")
    return found(spark, d).withColumn("m", m).select("incident_id", "item_name", "occurrence_key", "m.rows_delivered", micros("m.run_started").alias("started_us"), "summary")


@query(f"WITH {_DELIVERED} SELECT run_id, rows_delivered FROM del")
def rows_delivered(spark, d):
    return silent_delivery.deliveries(runs(spark, d), commits(spark, d), expected(spark, d), cutoff(spark, d)).select("run_id", "rows_delivered")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, v.value AS value, epoch_us(v.ts) AS seen_us FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_sample(spark, d):
    e = table(spark, d, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), "value", micros("ts").alias("seen_us"))
    return intervals.as_of(p, v, ["user_id"], "ts", "at", ["value", "seen_us"]).select("event_id", "user_id", "value", "seen_us")


@query("""WITH p AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT ts, value FROM events WHERE event_type = 'view') SELECT p.event_id, v.value AS value FROM p ASOF LEFT JOIN v ON p.ts >= v.ts""")
def as_of_any_source(spark, d):
    e = table(spark, d, "events")
    v = e.where("event_type = 'view'").select(F.col("ts").alias("at"), "value")
    return intervals.as_of(e.where("event_type = 'purchase'").select("event_id", "ts"), v, [], "ts", "at", ["value"]).select("event_id", "value")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, v.value AS value, epoch_us(v.ts) AS seen_us FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts""")
def next_sample(spark, d):
    e = table(spark, d, "events")
    v = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), "value", micros("ts").alias("seen_us"))
    return intervals.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), v, ["user_id"], "ts", "at", ["value", "seen_us"], forward=True).select("event_id", "user_id", "value", "seen_us")


@query("""WITH p AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT date_trunc('hour', ts) AS h, arg_min(event_id, event_id) AS first_id FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT p.event_id, v.first_id FROM p ASOF LEFT JOIN v ON p.ts >= v.h""")
def as_of_first_arrival(spark, d):
    """Views by the hour tie; the one that arrived first counts, although others have smaller values."""
    e = table(spark, d, "events")
    v = e.where("event_type = 'view'").select(F.date_trunc("hour", "ts").alias("at"), F.col("event_id").alias("first_id"), "value", F.col("event_id").alias("ingest_seq"))
    return intervals.as_of(e.where("event_type = 'purchase'").select("event_id", "ts"), v, [], "ts", "at", ["value", "first_id"], arrival=["ingest_seq"]).select("event_id", "first_id")


@query("""WITH e AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 2 HOUR AS e FROM events WHERE event_type = 'error')
SELECT a.event_id, count(b.event_id) AS n FROM e a LEFT JOIN e b ON b.s <= a.e AND b.e >= a.s AND a.user_id IS DISTINCT FROM b.user_id GROUP BY 1""")
def overlapping(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("user_id").alias("item"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"))
    return intervals.overlap_counts(e, e, "event_id").withColumnRenamed("id", "event_id")


@query(f"WITH {_RUNS} SELECT item_name, count(*) AS runs_observed, median(duration_seconds) AS duration_median, min(duration_seconds) AS duration_min, max(duration_seconds) AS duration_max, count(*) FILTER (status IS DISTINCT FROM 'Completed') AS failed_runs FROM runs GROUP BY 1")
def pipeline_baseline(spark, d):
    return evidence.pipeline_baseline(runs(spark, d))


@query(f"""WITH {_COMMITS} SELECT table_name, count(*) AS commits_observed, count(*) FILTER (rows_added = 0) AS zero_row_commits, count(*) FILTER (rows_added IS NULL) AS uncounted_commits, CAST(floor(median(rows_added) FILTER (rows_added > 0)) AS BIGINT) AS typical_delivery_rows,
  count(*) FILTER (rows_added > 0) AS deliveries_observed, epoch_us(max("timestamp") FILTER (rows_added > 0)) AS last_us FROM commits GROUP BY 1""")
def table_baseline(spark, d):
    return evidence.table_baseline(commits(spark, d)).withColumn("last_us", micros("last_delivery")).drop("last_delivery")


@query("""WITH s AS (SELECT user_id || '/' || event_type AS dataset, max(ts) AS seen FROM events GROUP BY ALL), g AS (SELECT *, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(seen)) / 86400000000.0::DOUBLE AS missed FROM s)
SELECT dataset, CASE WHEN missed >= 6 THEN 'high' ELSE 'medium' END AS severity, 'INC-' || substr(sha1('collection_gap||' || dataset || '|' || dataset || '|' || CASE WHEN epoch_us(seen) % 1000000 = 0 THEN strftime(seen, '%Y-%m-%dT%H:%M:%S') ELSE strftime(seen, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'), 1, 10) AS incident_id FROM g WHERE missed >= 2""")
def freshness_incidents(spark, d):
    seen = table(spark, d, "events").groupBy(F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("dataset")).agg(F.max("ts").alias("seen"))
    want = seen.select("dataset", F.lit(1440).cast("bigint").alias("every_minutes"), F.lit("").alias("workspace"))
    return freshness.detect(seen, want, now(spark, d)).select(F.col("item_name").alias("dataset"), "severity", "incident_id")


@query("""WITH v AS (SELECT l_suppkey, CAST(floor(l_quantity) AS BIGINT) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_partkey) AS version FROM lineitem)
SELECT l_suppkey AS table_name, version, CASE WHEN count(*) OVER (PARTITION BY l_suppkey) - version < 60 THEN n - lag(n) OVER (PARTITION BY l_suppkey ORDER BY version) END AS rows_added FROM v""")
def version_delta(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey")
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_name"), F.row_number().over(order).cast("bigint").alias("version"), F.floor("l_quantity").alias("n"))
    return versions.rows_added(v, 60).select("table_name", "version", "rows_added")


@query(f"WITH {_FAULTS}, {_ERRORS}, {_PAIRS} SELECT f.fault_id, count(p.incident_id) AS n, min(epoch_us(p.run_time) - epoch_us(p.injected_at)) / 1000000.0::DOUBLE / 3600.0::DOUBLE AS latency_hours FROM faults f LEFT JOIN pairs p USING (fault_id) GROUP BY 1")
def attribution(spark, d):
    return scoring.latency(errors(spark, d), faults(spark, d), now(spark, d))


@query(f"WITH {_FAULTS}, {_ERRORS}, {_PAIRS} SELECT f.fault_id, coalesce(string_agg(DISTINCT incident_id, ',' ORDER BY incident_id), '') AS incidents FROM faults f LEFT JOIN pairs p USING (fault_id) GROUP BY 1")
def matched(spark, d):
    return scoring.match(errors(spark, d), faults(spark, d), now(spark, d)).select("fault_id", F.array_join("incident_ids", ",").alias("incidents"))


@query(f"WITH {_FAULTS}, {_ERRORS}, {_PAIRS} SELECT incident_id, item_name FROM incidents WHERE incident_id NOT IN (SELECT incident_id FROM pairs)")
def unmatched(spark, d):
    return scoring.unmatched(errors(spark, d), faults(spark, d), now(spark, d)).select("incident_id", "item_name")


_COUNT = "SELECT '{0}_' || {1}, CAST(count(*) AS DOUBLE) FROM x WHERE {1} IS NOT NULL {2} GROUP BY {1}"


@query(f"""WITH {_FAULTS}, {_ERRORS}, {_PAIRS}, x AS (SELECT *, incident_id IN (SELECT incident_id FROM pairs) AS inside FROM incidents),
l AS (SELECT f.fault_id, count(p.incident_id) AS n, {_HUNDREDTHS} / 100.0::DOUBLE AS h FROM faults f LEFT JOIN pairs p USING (fault_id) GROUP BY 1),
o AS (SELECT list_sort(list(h) FILTER (h IS NOT NULL)) AS hs FROM l), m(metric, value) AS (
SELECT 'faults_sealed', count(*)::DOUBLE FROM l UNION ALL SELECT 'faults_detected', (count(*) FILTER (n > 0))::DOUBLE FROM l UNION ALL SELECT 'faults_missed', (count(*) FILTER (n = 0))::DOUBLE FROM l UNION ALL SELECT 'incidents_matched', sum(n)::DOUBLE FROM l
UNION ALL SELECT 'latency_hours_median', hs[len(hs) // 2 + 1] FROM o UNION ALL SELECT 'latency_hours_worst', hs[len(hs)] FROM o UNION ALL SELECT 'faults_still_live', (count(*) FILTER (reverted_at IS NULL))::DOUBLE FROM faults
UNION ALL SELECT 'incidents_total', count(*)::DOUBLE FROM x UNION ALL SELECT 'incidents_unmatched', (count(*) FILTER (NOT inside))::DOUBLE FROM x UNION ALL SELECT 'judged_against_seal', (count(verdict) FILTER (inside))::DOUBLE FROM x
UNION ALL SELECT 'judged_without_seal', (count(verdict) FILTER (NOT inside))::DOUBLE FROM x UNION ALL SELECT 'diagnosed_awaiting_verdict', (count(*) FILTER (diagnosis_cause IS NOT NULL AND verdict IS NULL))::DOUBLE FROM x
UNION ALL SELECT 'undiagnosed', (count(*) FILTER (diagnosis_cause IS NULL))::DOUBLE FROM x UNION ALL {_COUNT.format('diagnosis', 'diagnosis_source', '')} UNION ALL {_COUNT.format('verdict', 'verdict', 'AND inside')} UNION ALL {_COUNT.format('unsealed_verdict', 'verdict', 'AND NOT inside')}
UNION ALL {_COUNT.format('decision', 'decision', '')} UNION ALL {_COUNT.format('proposal', 'proposal_target', '')}) SELECT metric, value FROM m""")
def benchmark_results(spark, d):
    return scoring.results(errors(spark, d), faults(spark, d), now(spark, d))


@query(f"""WITH {_ERRORS} SELECT unnest(['incidents', 'diagnosed', 'by_model', 'abstained', 'by_fallback', 'proposed', 'no_change_warranted', 'pending']) AS metric, unnest([count(*), count(diagnosis_cause), count(*) FILTER (diagnosis_source = 'model'), count(*) FILTER (diagnosis_source = 'abstention'),
  count(*) FILTER (diagnosis_source = 'fallback'), count(proposal_target) - count(*) FILTER (proposal_target = 'none'), count(*) FILTER (proposal_target = 'none'), count(*) FILTER (coalesce(decision, 'pending') = 'pending')]) AS value FROM incidents""")
def store_summary(spark, d):
    return incidents.summary(errors(spark, d))


@query(f"WITH {_ERRORS} SELECT incident_id, decision FROM incidents WHERE decision IS NULL OR decision = 'pending'")
def pending(spark, d):
    return incidents.pending(errors(spark, d)).select("incident_id", "decision")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_expand(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("props").alias("measured_json"))
    return incidents.measured(e, names=["k"]).select("event_id", "k")


@query("SELECT event_id, CAST(event_id % 1000 AS VARCHAR) AS \"a.v\", event_type AS \"a.b.kind\", CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS u, CAST(NULL AS VARCHAR) AS gone FROM events")
def json_expand_nested(spark, d):
    e = table(spark, d, "events")
    inner = F.struct((F.col("event_id") % 1000).alias("v"), F.struct(F.col("event_type").alias("kind")).alias("b"))
    text = F.to_json(F.struct(inner.alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("u")))
    return incidents.measured(e.select("event_id", text.alias("measured_json")), names=["a.v", "a.b.kind", "u", "gone"])


@query("SELECT 'a.b.kind' AS name, 'STRING' AS kind, count(*) AS n FROM events UNION ALL SELECT 'a.n', 'BIGINT', count(*) FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'u', 'BIGINT', count(*) FROM events WHERE event_id % 3 = 0")
def json_names(spark, d):
    e = table(spark, d, "events")
    inner = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("n"), F.struct(F.col("event_type").alias("kind")).alias("b"))
    text = F.to_json(F.struct(inner.alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("u")))
    return incidents.measured_names(e.select(text.alias("measured_json")))


@query("SELECT o_orderkey, o_orderpriority || '#' || o_orderkey AS wide, o_orderpriority AS narrow FROM orders")
def widen_narrow(spark, d):
    o = table(spark, d, "orders").withColumn("wide", widened(F.col("o_orderpriority"), F.col("o_orderkey")))
    return o.select("o_orderkey", "wide", narrowed(F.col("wide")).alias("narrow"))


@query("""SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS distinct_values, count(DISTINCT o_orderstatus) / count(*)::DOUBLE AS share FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(DISTINCT o_custkey) / count(*)::DOUBLE FROM orders
UNION ALL SELECT 'o_orderkey', count(DISTINCT o_orderkey), count(DISTINCT o_orderkey) / count(*)::DOUBLE FROM orders""")
def cardinality_profile(spark, d):
    return profile.cardinalities(table(spark, d, "orders"), ["o_orderstatus", "o_custkey", "o_orderkey"])


@query("""SELECT epoch_us(date_trunc('day', ts)) AS day_us, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1""")
def daily_rollup(spark, d):
    return profile.daily(table(spark, d, "events"), "ts").select(micros(F.col("day").cast("timestamp")).alias("day_us"), "n", micros("first").alias("first_us"), micros("last").alias("last_us"))


@query("SELECT CASE WHEN value < 50 THEN event_type END AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "events").select(F.when(F.col("value") < 50, F.col("event_type")).alias("t")), "t")


@query(f"""WITH {_COMMITS} SELECT CASE WHEN "timestamp" < TIMESTAMP '2024-01-15 00:00:00' THEN 'before' ELSE 'after' END AS period, count(*) AS judged, count(*) FILTER (rows_added > 0) AS delivered, count(*) FILTER (rows_added = 0) AS "none", count(*) FILTER (rows_added IS NULL) AS unknown,
  CAST(floor(median(rows_added) FILTER (rows_added > 0)) AS BIGINT) AS typical FROM commits GROUP BY 1""")
def before_and_after(spark, d):
    return profile.before_and_after(commits(spark, d), "timestamp", F.lit("2024-01-15 00:00:00").cast("timestamp"), "rows_added")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%')")
def integrity(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return intervals.split_by(table(spark, d, "customer").select("c_custkey"), o, "c_custkey")[1]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def membership(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return intervals.split_by(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")[0]


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(floor(value) AS BIGINT) AS value, NULL::VARCHAR AS note, user_id FROM events")
def conform_to_schema(spark, d):
    from pyspark.sql import types as T

    e = table(spark, d, "events").select("user_id", F.floor("value").cast("double").alias("value"), "event_id")
    return store.conform(e, T.StructType.fromDDL("event_id string, value bigint, note string"))


@query("SELECT n_name AS name, n_regionkey AS regionkey, NULL::BIGINT AS suppkey FROM nation UNION ALL SELECT s_name, NULL, s_suppkey FROM supplier")
def union_of_batches(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"))
    return profile.bag_union(n, table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("bigint").alias("suppkey")))


@query("""WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['run.id'] WHEN 2 THEN ['run.id', 'made.up'] ELSE ['run.status'] END AS cited, event_id % 7 = 0 AS exempt FROM events)
SELECT event_id, CASE WHEN exempt THEN NULL WHEN len(list_filter(cited, lambda x: x NOT IN ('run.id', 'run.status'))) > 0 THEN 'cites evidence that does not exist: made.up' WHEN len(cited) = 0 THEN 'cites no evidence' END AS error FROM c""")
def citations(spark, d):
    m = F.col("event_id") % 4
    a = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    cited = F.when(m == 0, a()).when(m == 1, a("run.id")).when(m == 2, a("run.id", "made.up")).otherwise(a("run.status"))
    return table(spark, d, "events").select("event_id", claims.citation_error(cited, a("run.id", "run.status"), F.col("event_id") % 7 == 0).alias("error"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - INTERVAL 6 HOUR > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) THEN 1 ELSE 0 END AS new FROM events WHERE event_type = 'error'),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM e) SELECT user_id, island, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM i GROUP BY 1, 2""")
def islands(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("user_id", "ts")
    return extras.island_spans(e, ["user_id"], "ts", "6 HOURS").select("user_id", F.col("island").cast("bigint").alias("island"), micros("first").alias("first_us"), micros("last").alias("last_us"), "n")


@query("""WITH a AS (SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-16 00:00:00') - count(*) FILTER (ts < TIMESTAMP '2024-01-16 00:00:00') AS change FROM events GROUP BY 1), t AS (SELECT sum(change) AS total, sum(abs(change)) AS moved, min(change) < 0 AND max(change) > 0 AS mixed FROM a)
SELECT event_type, change::DOUBLE AS change, round(CASE WHEN mixed THEN abs(change) / moved::DOUBLE ELSE change / nullif(total, 0)::DOUBLE END, 9) AS share, mixed FROM a, t""")
def contributions(spark, d):
    e = table(spark, d, "events").select("event_type", "ts", F.lit(1.0).alias("one"))
    out = extras.contributions(e.where("ts >= '2024-01-16 00:00:00'"), e.where("ts < '2024-01-16 00:00:00'"), "event_type", "one")
    return out.withColumn("share", F.round("share", 9))


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS base_mean, count(value) OVER w AS base_n FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def rolling_baseline(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return extras.rolling_baseline(e, "user_id", "ts", "value", 7).select("event_id", F.round("base_mean", 6).alias("base_mean"), "base_n")


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders")
def share_of_parent(spark, d):
    return extras.share_of_parent(table(spark, d, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", F.round("share", 9).alias("share"))


@query("""SELECT user_id, epoch_us(ts) AS from_us, epoch_us(nxt) AS to_us FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events) WHERE epoch_us(nxt) - epoch_us(ts) > 2 * 43200 * 1000000::BIGINT""")
def coverage_holes(spark, d):
    return extras.coverage_holes(table(spark, d, "events"), "user_id", "ts", 43200.0).select("user_id", micros("from").alias("from_us"), micros("to").alias("to_us"))


def months(spark, d):
    """Suppliers are tables, months of shipping their versions."""
    return table(spark, d, "lineitem").withColumns({"t": F.col("l_suppkey"), "v": F.year("l_shipdate") * 12 + F.month("l_shipdate")})


_MONTHS = "m AS (SELECT *, l_suppkey AS t, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS v FROM lineitem)"


@query(f"""WITH {_MONTHS}, v AS (SELECT t, v, list_sort(list(DISTINCT l_returnflag || l_linestatus || l_linenumber)) AS cols FROM m GROUP BY 1, 2), b AS (SELECT *, lag(cols) OVER (PARTITION BY t ORDER BY v) AS prev FROM v),
x AS (SELECT t, v, list_sort(list_filter(cols, lambda c: NOT list_contains(prev, c))) AS a, list_sort(list_filter(prev, lambda c: NOT list_contains(cols, c))) AS d FROM b WHERE prev IS NOT NULL) SELECT t, v, array_to_string(a, ',') AS added, array_to_string(d, ',') AS dropped FROM x WHERE len(a) > 0 OR len(d) > 0""")
def schema_drift(spark, d):
    v = months(spark, d).groupBy("t", "v").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))).alias("cols"))
    return extras.schema_drift(v, "t", "v", "cols").select("t", "v", F.array_join(F.array_sort("added"), ",").alias("added"), F.array_join(F.array_sort("dropped"), ",").alias("dropped"))


@query(f"WITH {_RUNS}, {_COMMITS} SELECT DISTINCT item_name AS name FROM runs WHERE item_name NOT IN (SELECT table_name FROM commits WHERE rows_added > 95)")
def unresolved_names(spark, d):
    return profile.not_found(runs(spark, d).select(F.col("item_name").alias("name")).distinct(), commits(spark, d).where("rows_added > 95"), "name", "table_name")


def landing(spark, d):
    """Views as samples of sources, that of the user."""
    v = table(spark, d, "events").where("event_type = 'view'")
    rows = F.when(F.col("value") >= 5, F.floor("value")).cast("bigint")
    return v.select(F.col("user_id").cast("string").alias("source_name"), (F.col("value") > 10).alias("exists"), rows.alias("data_rows"), (F.col("event_id") * 100).alias("size_bytes"), (F.date_trunc("day", "ts") - F.expr("INTERVAL 1 DAY")).alias("modified_at"), F.col("ts").alias("collected_at"))


def wide_facts(spark, d):
    """The facts about all incidents, which are few beside the telemetry and are written, as if they came from the store."""
    return evidence.facts(written(found(spark, d), "incidents"), runs(spark, d), commits(spark, d), landing(spark, d), now(spark, d))


_FACTS = f"""{_DELIVERED}, now AS (SELECT max(ts) AS t FROM events), i AS (SELECT 'INC-' || substr(sha1('silent_zero_row|w|' || item_name || '|' || run_id), 1, 10) AS incident_id, * FROM del WHERE rows_delivered < 20),
pb AS (SELECT item_name, count(*) AS runs_observed, median(duration_seconds) AS d_median, min(duration_seconds) AS d_min, max(duration_seconds) AS d_max, count(*) FILTER (status IS DISTINCT FROM 'Completed') AS failed FROM runs GROUP BY 1),
tb AS (SELECT table_name, count(*) AS given, count(*) FILTER (rows_added = 0) AS zero, count(*) FILTER (rows_added IS NULL) AS uncounted, CAST(floor(median(rows_added) FILTER (rows_added > 0)) AS BIGINT) AS typical, count(*) FILTER (rows_added > 0) AS deliveries, max("timestamp") FILTER (rows_added > 0) AS last FROM commits GROUP BY 1),
smp AS (SELECT ts AS seen, min({{'source_name': CAST(user_id AS VARCHAR), 'e': value > 10, 'r': CAST(CASE WHEN value >= 5 THEN floor(value) END AS BIGINT), 'b': event_id * 100, 'm': date_trunc('day', ts) - INTERVAL 1 DAY}}) AS s, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1),
cum AS (SELECT *, CAST(sum(n) OVER (ORDER BY seen) AS BIGINT) AS samples FROM smp),
con AS (SELECT i.incident_id, count(r.run_id) AS beside FROM i LEFT JOIN runs r ON r.start_time <= i.end_time AND r.end_time >= i.start_time AND r.item_name <> i.item_name GROUP BY 1),
w AS (SELECT i.*, pb.* EXCLUDE (item_name), tb.* EXCLUDE (table_name), cum.seen, cum.s, coalesce(cum.samples, 0) AS samples, con.beside, {_even("epoch_us((SELECT t FROM now)) - epoch_us(tb.last)", 360_000_000)} / 10.0::DOUBLE AS hours_since, {_even("epoch_us(i.start_time) - epoch_us(cum.s.m)", 360_000_000)} / 10.0::DOUBLE AS hours_old
  FROM i LEFT JOIN pb USING (item_name) LEFT JOIN tb ON tb.table_name = i.item_name JOIN con USING (incident_id) ASOF LEFT JOIN cum ON i.end_time >= cum.seen)"""
_KEYED = {
    "run.id": ("run_id", "true"), "run.started": (_iso("start_time"), "true"), "run.ended": (_iso("end_time"), "true"), "run.duration_seconds": ("duration_seconds", "true"), "run.status": ("'Completed'", "true"), "run.rows_delivered": ("rows_delivered", "true"),
    "expectation.minimum_rows": ("20", "true"), "expectation.target_table": ("item_name", "true"), "pipeline.runs_observed": ("coalesce(runs_observed, 0)", "true"), "pipeline.duration_median_seconds": ("d_median", "d_median IS NOT NULL"),
    "pipeline.duration_min_seconds": ("d_min", "d_min IS NOT NULL"), "pipeline.duration_max_seconds": ("d_max", "d_max IS NOT NULL"), "pipeline.failed_runs": ("failed", "runs_observed > 0"), "table.commits_observed": ("coalesce(given, 0)", "true"),
    "table.zero_row_commits": ("zero", "given > 0"), "table.uncounted_commits": ("uncounted", "given > 0"), "table.typical_delivery_rows": ("typical", "deliveries > 0"), "table.deliveries_observed": ("deliveries", "deliveries > 0"),
    "table.last_delivery_at": (_iso("last"), "last IS NOT NULL"), "table.hours_since_last_delivery": ("hours_since", "last IS NOT NULL"), "coverage.source_measured": ("CASE WHEN samples > 0 THEN 'True' ELSE 'False' END", "true"), "coverage.source_samples": ("samples", "true"),
    "source.name": ("s.source_name", "s IS NOT NULL"), "source.sampled_at": (_iso("seen"), "s IS NOT NULL"), "source.exists": ("CASE WHEN s.e THEN 'True' ELSE 'False' END", "s IS NOT NULL"), "source.data_rows": ("s.r", "s IS NOT NULL"), "source.size_bytes": ("s.b", "s IS NOT NULL"),
    "source.modified_at": (_iso("s.m"), "s IS NOT NULL"), "source.hours_old_at_run": ("hours_old", "s IS NOT NULL"), "estate.concurrent_runs": ("beside", "true"),
}
_PACKS = f"WITH {_FACTS} " + " UNION ALL ".join(f"SELECT incident_id, '{k}' AS key, CAST({v} AS VARCHAR) AS value FROM w WHERE {held}" for k, (v, held) in _KEYED.items())


@query(_PACKS)
def evidence_packs(spark, d):
    return evidence.pack(wide_facts(spark, d)).select("incident_id", "key", "value")


@query(f"WITH p AS ({_PACKS}) SELECT incident_id, count(*) AS lines, count(*) FILTER (value IS NULL) AS unknown, max(length(key)) AS longest FROM p GROUP BY 1")
def evidence_prompts(spark, d):
    lines = F.split("prompt", "\n")
    unknown = F.filter(lines, lambda x: x.contains(" = unknown   ("))
    return evidence.prompts(evidence.pack(wide_facts(spark, d))).select("incident_id", F.size(lines).cast("bigint").alias("lines"), F.size(unknown).cast("bigint").alias("unknown"), F.array_max(F.transform(lines, lambda x: F.length(F.substring_index(x, " = ", 1)))).cast("bigint").alias("longest"))


_LABELS = "l(ord, key, label) AS (VALUES " + ", ".join(f"({n}, '{k}', '{label.replace(chr(39), chr(39) * 2)}')" for n, (k, _, label) in enumerate(evidence.FACTS)) + ")"


@query(f"WITH p AS ({_PACKS}), {_LABELS} SELECT incident_id, string_agg(key || ' = ' || coalesce(value, 'unknown') || '   (' || label || ')', chr(10) ORDER BY ord) AS prompt FROM p JOIN l USING (key) GROUP BY 1")
def evidence_prompt_text(spark, d):
    return evidence.prompts(evidence.pack(wide_facts(spark, d)))


@query(f"""WITH {_FACTS} SELECT incident_id, 'not diagnosed — measured facts only' AS diagnosis_cause, 'The run ended as a success with ' || rows_delivered || ' rows in ' || item_name || '.' || coalesce(' Its length was ' || CAST(duration_seconds AS VARCHAR) || ' s; the median of the pipeline is ' || CAST(d_median AS VARCHAR) || ' s.', '')
  || coalesce(' Commits with rows add ' || typical || ' at the median.', '') || coalesce(' The last one was ' || CAST(hours_since AS VARCHAR) || ' hours ago.', '') AS diagnosis_reasoning,
  '["run.rows_delivered","run.duration_seconds"' || CASE WHEN d_median IS NOT NULL THEN ',"pipeline.duration_median_seconds"' ELSE '' END || CASE WHEN deliveries > 0 THEN ',"table.typical_delivery_rows"' ELSE '' END || CASE WHEN last IS NOT NULL THEN ',"table.hours_since_last_delivery"' ELSE '' END || ']' AS cited,
  'low' AS confidence, 'fallback' AS source, 'model unavailable: no model is configured' AS reason FROM w""")
def template_diagnoses(spark, d):
    replies = wide_facts(spark, d).withColumns({"reply": F.lit(None).cast("string"), "unavailable": F.lit("no model is configured")})
    out = claims.diagnoses(replies, "none", now(spark, d))
    return out.select("incident_id", "diagnosis_cause", "diagnosis_reasoning", F.col("diagnosis_cited_json").alias("cited"), F.col("diagnosis_confidence").alias("confidence"), F.col("diagnosis_source").alias("source"), F.col("fallback_reason").alias("reason"))


@query()
def seeded_ledger(spark, d):
    from datetime import date

    from vigil.plans.datagen import ledger

    return ledger(spark, 20_000, 4417, date(2026, 1, 1), date(2026, 6, 30))


@query(f"WITH {_COMMITS} SELECT epoch_us(max(\"timestamp\") - INTERVAL 10 MINUTE) AS cutoff_us FROM commits")
def complete_until(spark, d):
    return latest.complete_until(commits(spark, d), None).select(micros("cutoff").alias("cutoff_us"))


@query(f"""WITH {_RUNS}, {_COMMITS} SELECT run_id, item_name FROM runs WHERE status = 'Completed' AND end_time < (SELECT max("timestamp") - INTERVAL 10 MINUTE FROM commits)""")
def eligible_runs(spark, d):
    return silent_delivery.eligible(runs(spark, d), cutoff(spark, d)).select("run_id", "item_name")


@query("SELECT count(*) AS stored, count(DISTINCT (user_id, event_type)) AS distinct_facts FROM events")
def stored_and_distinct(spark, d):
    return latest.stored_and_distinct(table(spark, d, "events"), ["user_id", "event_type"]).withColumnRenamed("distinct", "distinct_facts")


@query("""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS dataset_id, ts, event_id, CASE WHEN value < 60 THEN 'Completed' ELSE 'Failed' END AS status, CASE WHEN value >= 60 THEN 'e' || CAST(floor(value / 20) AS BIGINT) END AS error, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS n FROM events WHERE event_type = 'view'),
g AS (SELECT dataset_id, max(ts) FILTER (status = 'Completed') AS ok, count(error) FILTER (n <= 3) AS errors, count(DISTINCT error) FILTER (n <= 3) AS kinds FROM r GROUP BY 1),
x AS (SELECT dataset_id, epoch_us(ok) AS last_us, CASE WHEN errors = 3 AND kinds = 1 THEN 'repeated error' WHEN ok IS NULL THEN 'never succeeded' WHEN (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ok)) / 3600000000.0::DOUBLE > 48 THEN 'overdue' END AS reason FROM g) SELECT * FROM x WHERE reason IS NOT NULL""")
def stale_models(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    failed = F.col("value") >= 60
    r = e.select(
        F.col("user_id").cast("string").alias("dataset_id"), F.col("event_id").cast("string").alias("refresh_id"), F.when(failed, "Failed").otherwise("Completed").alias("status"), F.col("ts").alias("start_time"), F.col("ts").alias("end_time"),
        F.when(failed, F.concat(F.lit("e"), F.floor(F.col("value") / 20).cast("string"))).alias("error"),
    )
    return extras.stale_models(r, now(spark, d), 48.0).select("dataset_id", micros("last_success").alias("last_us"), "reason")


@query("""WITH c AS (SELECT user_id, ts AS changed FROM events WHERE event_type = 'signup'), d AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT c.user_id, epoch_us(c.changed) AS changed_us, round(avg(d.value) FILTER (d.ts < c.changed), 6) AS before, round(avg(d.value) FILTER (d.ts >= c.changed), 6) AS after FROM c LEFT JOIN d ON d.user_id = c.user_id AND d.ts BETWEEN c.changed - INTERVAL 48 HOUR AND c.changed + INTERVAL 48 HOUR GROUP BY 1, 2""")
def savings(spark, d):
    e = table(spark, d, "events")
    c = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("changed"))
    out = extras.saving(e.where("event_type = 'purchase'"), c, "user_id", "ts", "value", "changed")
    return out.select("user_id", micros("changed").alias("changed_us"), F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query(f"""WITH {_MONTHS}, p AS (SELECT t, v, count(DISTINCT l_partkey) AS n, count(*) AS size FROM m GROUP BY 1, 2), b AS (SELECT *, lag(n) OVER w AS before, lag(size) OVER w AS size_before FROM p WINDOW w AS (PARTITION BY t ORDER BY v))
SELECT t, v, n, size, before FROM b WHERE n >= 2.0 * before AND size >= 1.5 * size_before""")
def bloat(spark, d):
    p = months(spark, d).groupBy("t", "v").agg(F.count_distinct("l_partkey").alias("n"), F.count("*").alias("size"))
    return extras.bloated(p, "t", "v", "n", also={"size": 1.5})


@query(f"""WITH {_FAULTS}, {_ERRORS}, {_PAIRS}, l AS (SELECT f.fault_id, f.injected_at, f.reverted_at, count(p.incident_id) AS n, {_HUNDREDTHS} AS h FROM faults f LEFT JOIN pairs p USING (fault_id, injected_at) GROUP BY ALL)
SELECT fault_id, n AS incidents, CASE WHEN h IS NULL THEN '—' ELSE (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') END AS latency_h, strftime(injected_at, '%d %b %H:%M') || ' to ' || coalesce(strftime(reverted_at, '%d %b %H:%M'), 'LIVE') AS "window" FROM l""")
def fault_table(spark, d):
    return scoring.table(errors(spark, d), faults(spark, d), now(spark, d))


@query(f"""WITH {_COMMITS}, p AS (SELECT table_name, quantile_cont(rows_added, 0.5) AS half, quantile_cont(rows_added, 0.9) AS most, quantile_cont(rows_added, 0.0) AS least FROM commits WHERE rows_added > 0 GROUP BY 1) SELECT table_name, round(half, 6) AS half, round(most, 6) AS most, round(least, 6) AS least FROM p""")
def delivery_quantiles(spark, d):
    out = order.quantiles(commits(spark, d), ["table_name"], F.when(F.col("rows_added") > 0, F.col("rows_added")), {"half": 0.5, "most": 0.9, "least": 0.0})
    return out.select("table_name", *(F.round(c, 6).alias(c) for c in ("half", "most", "least")))


@query(ORACLES["pipeline_baseline"])
def pipeline_baseline_spread(spark, d):
    return evidence.pipeline_baseline(runs(spark, d), spread=True)


@query(ORACLES["table_baseline"])
def table_baseline_spread(spark, d):
    return evidence.table_baseline(commits(spark, d), spread=True).withColumn("last_us", micros("last_delivery")).drop("last_delivery")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1 AS place_of_status FROM orders")
def places(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    whole = order.running(o, ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("before").alias("place"))
    return whole.join(order.running(o, ["o_totalprice", "o_orderkey"], ["o_orderstatus"]).select("o_orderkey", F.col("before").alias("place_of_status")), "o_orderkey")


@query("SELECT event_id, ts_us FROM (SELECT event_id, epoch_us(ts) AS ts_us, ts FROM events WHERE event_type = 'error' ORDER BY ts LIMIT 1)")
def earliest_by(spark, d):
    return profile.earliest(table(spark, d, "events").where("event_type = 'error'").select("event_id", "ts"), "ts").select("event_id", micros("ts").alias("ts_us"))


_DRILL = """WITH e AS (SELECT event_type AS a, user_id % 5 AS b, CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN value ELSE -value END AS v FROM events), l1 AS (SELECT a, sum(v) AS c FROM e GROUP BY 1),
t1 AS (SELECT *, sum(c) OVER () AS total, sum(abs(c)) OVER () AS moved, min(c) OVER () < 0 AND max(c) OVER () > 0 AS mixed FROM l1), s1 AS (SELECT *, CASE WHEN mixed THEN abs(c) / moved ELSE c / total END AS share FROM t1 ORDER BY share DESC, a LIMIT 1),
l2 AS (SELECT b, sum(v) AS c FROM e WHERE a = (SELECT a FROM s1) AND (SELECT share FROM s1) >= {0} GROUP BY 1), t2 AS (SELECT *, sum(c) OVER () AS total, sum(abs(c)) OVER () AS moved, min(c) OVER () < 0 AND max(c) OVER () > 0 AS mixed FROM l2),
s2 AS (SELECT *, CASE WHEN mixed THEN abs(c) / moved ELSE c / total END AS share FROM t2 ORDER BY share DESC, b LIMIT 1)
SELECT 1 AS level, 'event_type' AS dimension, a AS segment, round(c, 3) AS change, round(share, 6) AS share, mixed, NULL::DOUBLE AS expected FROM s1
UNION ALL SELECT 2, 'part', CAST(b AS VARCHAR), round(c, 3), round(share, 6), mixed, round((SELECT c FROM s1) * (SELECT sum(v) FROM e WHERE e.b = s2.b) / (SELECT total FROM s1), 3) FROM s2"""


def drilled(spark, d, enough):
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("part"), "value", "ts")
    later = F.col("ts") >= "2024-01-16 00:00:00"
    out = extras.drill_path(e.where(later), e.where(~later), ["event_type", "part"], "value", enough, ["event_type", "part"])
    return out.select("level", "dimension", "segment", F.round("change", 3).alias("change"), F.round("share", 6).alias("share"), "mixed", F.round("expected", 3).alias("expected"))


@query(_DRILL.format("0.1"))
def drill_two_levels(spark, d):
    return drilled(spark, d, 0.1)


@query(_DRILL.format("0.99"))
def drill_that_stops(spark, d):
    return drilled(spark, d, 0.99)


@query(ORACLES["bloat"])
def bloat_by_sketches(spark, d):
    """From a sketch a month and column, not from rows."""
    p = profile.sketched_cardinalities(profile.column_sketches(months(spark, d), ["t", "v"], ["l_partkey"]))
    return extras.bloated(p.select("t", "v", F.col("distinct_values").alias("n"), F.col("rows").alias("size")), "t", "v", "n", also={"size": 1.5})


@query(f"WITH {_MONTHS} SELECT CAST(v // 12 AS INTEGER) AS year, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linenumber) AS numbers, count(*) AS size FROM m GROUP BY 1")
def yearly_profile_of_sketches(spark, d):
    """Months' sketches merged to years."""
    m = profile.column_sketches(months(spark, d), ["v"], ["l_returnflag", "l_linenumber"])
    years = profile.merged_sketches(m.withColumn("year", F.floor(F.col("v") / 12).cast("int")), ["year"])
    n = profile.sketched_cardinalities(years)
    of = lambda c: F.max(F.when(F.col("column") == c, F.col("distinct_values")))
    return n.groupBy("year").agg(of("l_returnflag").alias("flags"), of("l_linenumber").alias("numbers"), F.max("rows").alias("size"))


# ---- normalised interfaces: events as what the platform's interfaces answer ----


def raw_runs(spark, d):
    """Events of users as job runs of items: times as text, some without zone, some without end."""
    e = table(spark, d, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    end = F.date_format(F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 5000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select(
        F.col("user_id").cast("string").alias("itemId"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("jobType"), F.lit("Scheduled").alias("invokeType"), F.when(F.col("value") < 10, "Failed").otherwise("Completed").alias("status"),
        F.when(F.col("event_id") % 11 > 0, F.concat(text, F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))).alias("startTimeUtc"), F.when(F.col("event_id") % 7 > 0, F.concat(end, F.lit("Z"))).alias("endTimeUtc"), F.when(F.col("value") < 10, "bad").alias("failureReason"),
    )


def known_items(spark, d):
    kinds = F.array(*(F.lit(x) for x in ("DataPipeline", "Notebook", "Report", "SemanticModel")))
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select(F.lit("W").alias("workspace_id"), F.lit("w").alias("workspace_name"), F.col("user_id").cast("string").alias("item_id"), F.concat(F.lit("item "), F.col("user_id").cast("string")).alias("item_name"), F.element_at(kinds, (F.col("user_id") % 4 + 1).cast("int")).alias("item_type"))


_RAW = """r AS (SELECT CAST(user_id AS VARCHAR) AS item_id, user_id, CAST(event_id AS VARCHAR) AS run_id, CASE WHEN value < 10 THEN 'Failed' ELSE 'Completed' END AS status, CASE WHEN event_id % 11 > 0 THEN ts END AS st, CASE WHEN event_id % 7 > 0 THEN ts + INTERVAL 1 SECOND * (event_id % 5000) END AS en, value FROM events),
k AS (SELECT * FROM r WHERE st IS NULL OR st >= (SELECT max(ts) FROM events) - INTERVAL {0} DAY)"""
_KINDS = "['DataPipeline', 'Notebook', 'Report', 'SemanticModel'][user_id % 4 + 1]"


@query(f"""WITH {_RAW.format(10)} SELECT item_id, 'item ' || item_id AS item_name, {_KINDS} AS item_type, run_id, status, epoch_us(st) AS start_us, epoch_us(en) AS end_us, (epoch_us(en) - epoch_us(st)) / 1000000.0::DOUBLE AS duration_seconds, CASE WHEN value < 10 THEN 'bad' END AS failure_reason FROM k WHERE {_KINDS} <> 'Report'""")
def job_runs(spark, d):
    out = wire.job_runs(raw_runs(spark, d), known_items(spark, d), now(spark, d), 10)
    return out.select("item_id", "item_name", "item_type", "run_id", "status", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"), "duration_seconds", "failure_reason")


@query(f"""WITH {_RAW.format(20)} SELECT item_id AS dataset_id, 'model ' || item_id AS dataset_name, run_id AS refresh_id, status, epoch_us(st) AS start_us, (epoch_us(en) - epoch_us(st)) / 1000000.0::DOUBLE AS duration_seconds, CASE WHEN value < 10 THEN 'bad' END AS error FROM k WHERE user_id % 3 <> 0""")
def refresh_runs(spark, d):
    e = table(spark, d, "events").select("user_id").distinct()
    refreshable = F.when(F.col("user_id") % 3 == 0, False).when(F.col("user_id") % 3 == 1, True)  # and unknown, which is asked for
    models = e.select(F.lit("W").alias("workspace_id"), F.lit("w").alias("workspace_name"), F.col("user_id").cast("string").alias("dataset_id"), F.concat(F.lit("model "), F.col("user_id").cast("string")).alias("dataset_name"), refreshable.alias("is_refreshable"))
    r = raw_runs(spark, d).select(F.col("itemId").alias("dataset_id"), "id", F.col("id").alias("requestId"), F.col("jobType").alias("refreshType"), "status", F.col("startTimeUtc").alias("startTime"), F.col("endTimeUtc").alias("endTime"), F.col("failureReason").alias("serviceExceptionJson"))
    return wire.refresh_runs(r, models, now(spark, d), 20).select("dataset_id", "dataset_name", "refresh_id", "status", micros("start_time").alias("start_us"), "duration_seconds", "error")


@query(f"SELECT CAST(user_id AS VARCHAR) AS item_id, 'workspaces/W/items/' || user_id || '/jobs/instances' AS path FROM (SELECT DISTINCT user_id FROM events) WHERE {_KINDS} <> 'Report'")
def run_paths(spark, d):
    return wire.run_paths(known_items(spark, d))


# ---- latest values, freshness, the store ----


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_facts(spark, d):
    return latest.latest_known(table(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query(f"WITH {_COMMITS} SELECT table_name, version, rows_added FROM commits")
def commits_view(spark, d):
    """Each commit is collected three times, its rows known at the second only."""
    c = commits(spark, d)
    again = lambda h, known: c.withColumns({"collected_at": F.col("timestamp") + F.make_dt_interval(hours=F.lit(h)), "rows_added": F.when(F.lit(known), F.col("rows_added")), "ingest_seq": F.lit(h).cast("bigint")})
    return latest.view(again(1, False).unionByName(again(2, True)).unionByName(again(3, False)), "delta_commits").select("table_name", "version", "rows_added")


@query("""SELECT CAST(user_id AS VARCHAR) || '/never' AS dataset, 'high' AS severity, 'INC-' || substr(sha1('collection_gap||' || user_id || '/never|' || user_id || '/never|never'), 1, 10) AS incident_id,
  user_id || '/never has never been collected. Every rule that reads it is reporting on an empty table, which looks identical to a healthy estate.' AS summary FROM (SELECT DISTINCT user_id FROM events)""")
def never_collected(spark, d):
    e = table(spark, d, "events")
    seen = e.groupBy(F.col("user_id").cast("string").alias("dataset")).agg(F.max("ts").alias("seen"))
    want = e.select(F.concat(F.col("user_id").cast("string"), F.lit("/never")).alias("dataset"), F.lit(60).cast("bigint").alias("every_minutes"), F.lit("").alias("workspace")).distinct()
    return freshness.detect(seen, want, now(spark, d)).select(F.col("item_name").alias("dataset"), "severity", "incident_id", "summary")


def sparse_rows(spark, d):
    """Errors recorded, some decided, some superseded later, all recorded again without a decision: sparse rows as the store gets them."""
    e = table(spark, d, "events").where("event_type = 'error'")
    n, at = F.col("event_id"), lambda h: F.col("ts") + F.make_dt_interval(hours=F.lit(h))
    row = lambda h, decision, note, severity, proposal: e.select(n.cast("string").alias("incident_id"), decision.alias("decision"), note.alias("reviewer_note"), severity.alias("severity"), proposal.alias("proposal_target"), at(h).alias("collected_at"), F.lit(h).cast("bigint").alias("ingest_seq"))
    none = F.lit(None).cast("string")
    recorded = row(0, none, none, F.lit("high"), F.when(n % 2 == 0, "pipeline"))
    decided = row(1, F.when(n % 3 == 0, "approved").otherwise("pending"), F.lit("first"), none, none).where("decision = 'approved' or incident_id % 5 = 0")
    changed = row(2, F.lit("superseded"), F.lit("second"), none, none).where("incident_id % 6 = 0")
    return recorded.unionByName(decided).unionByName(changed).unionByName(row(3, none, none, F.lit("medium"), none))


_SPARSE = """SELECT CAST(event_id AS VARCHAR) AS incident_id, CASE WHEN event_id % 6 = 0 THEN 'superseded' WHEN event_id % 3 = 0 THEN 'approved' WHEN event_id % 5 = 0 THEN 'pending' END AS decision, CASE WHEN event_id % 6 = 0 THEN 'second' WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'first' END AS reviewer_note,
  'medium' AS severity, CASE WHEN event_id % 2 = 0 THEN 'pipeline' END AS proposal_target FROM events WHERE event_type = 'error'"""


@query(_SPARSE)
def sparse_store(spark, d):
    return latest.latest_known(sparse_rows(spark, d), ["incident_id"]).drop("collected_at", "ingest_seq")


def new_store(spark):
    return store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query(_SPARSE.replace("'first'", "'bulk'").replace("'second'", "'late'") )
def store_round_trip(spark, d):
    """The sparse rows through the store: recorded, decided in bulk, recorded again, decided anew, read back."""
    e = table(spark, d, "events").where("event_type = 'error'")
    n, s, at = F.col("event_id"), new_store(spark), lambda h: datetime(2024, 3, 1, h, tzinfo=timezone.utc)
    key = n.cast("string").alias("incident_id")
    proposed = e.where("event_id % 2 = 0").select(key, F.lit("pipeline").alias("proposal_target"))
    incidents.record(s, e.select(key, F.lit("high").alias("severity")), None, proposed, at(0))
    words = F.when(n % 3 == 0, "approved").otherwise("pending")
    incidents.decide_all(s, e.where("event_id % 3 = 0 or event_id % 5 = 0").select(key, words.alias("decision"), F.lit("me").alias("decided_by"), F.lit("bulk").alias("reviewer_note")), at(1))
    incidents.decide_all(s, e.where("event_id % 6 = 0").select(key, F.lit("superseded").alias("decision"), F.lit("me").alias("decided_by"), F.lit("late").alias("reviewer_note")), at(2))
    incidents.record(s, e.select(key, F.lit("medium").alias("severity")), None, None, at(3))
    return incidents.load(s).select("incident_id", "decision", "reviewer_note", "severity", "proposal_target")


@query("""SELECT CAST(min(event_id) AS VARCHAR) AS incident_id, 'approved' AS decision, 'correct' AS verdict, 'f1' AS benchmark_ref, CAST(5 AS BIGINT) AS stored FROM events WHERE event_type = 'error'""")
def decide_judge_link(spark, d):
    """One incident of all that the store holds is decided, judged and linked; an unknown one changes nothing."""
    e = table(spark, d, "events").where("event_type = 'error'")
    s, at = new_store(spark), datetime(2024, 3, 1, tzinfo=timezone.utc)
    incidents.record(s, e.select(F.col("event_id").cast("string").alias("incident_id")), None, None, at)
    one = str(e.agg(F.min("event_id")).first()[0])
    for wrong in ("none", "nope"):
        try:
            incidents.decide(s, wrong, "approved", "me", "", at)
        except KeyError:
            continue
    incidents.decide(s, one, "pending", "me", "", at)
    incidents.decide(s, one, "approved", "me", "", at)
    incidents.judge(s, one, "correct", "me", "", at)
    incidents.link_to_fault(s, one, "f1", at)
    many = s.read("incidents").where(F.col("incident_id") == one).agg(F.count("*").alias("stored"))
    return incidents.get(incidents.load(s), one).select("incident_id", "decision", "verdict", "benchmark_ref").crossJoin(F.broadcast(many))  # one row


@query("""WITH c AS (SELECT 'delta_commits' AS dataset, max(ts) AS seen, count(*) AS stored, count(DISTINCT event_id) AS facts FROM events WHERE event_type = 'click' UNION ALL SELECT 'job_runs', max(ts), 2 * count(*), count(DISTINCT event_id) FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'landing_files', NULL, 0, 0)
SELECT dataset, epoch_us(seen) AS seen_us, CAST(stored AS BIGINT) AS stored, CAST(facts AS BIGINT) AS facts FROM c""")
def stored_telemetry(spark, d):
    """Runs, appended twice, and commits through a store: when each was last collected, and how many rows and facts it holds."""
    s = telemetry_store(spark, d)
    names = ["delta_commits", "job_runs", "landing_files"]
    seen = latest.last_collected(s, names).select("dataset", micros("seen").alias("seen_us"))
    return seen.join(latest.counts(s, names).select("dataset", "stored", F.col("distinct").alias("facts")), "dataset")


def telemetry_store(spark, d):
    s, at = new_store(spark), datetime(2024, 3, 1, tzinfo=timezone.utc)
    r = runs(spark, d).withColumn("collected_at", F.col("start_time"))
    s.write("job_runs", r, at)
    s.write("job_runs", r.withColumn("status", F.lit(None).cast("string")), at)
    s.write("delta_commits", commits(spark, d), at)
    return s


@query(f"WITH {_RUNS}, {_COMMITS} SELECT run_id, item_name, status, duration_seconds FROM runs")
def stored_runs(spark, d):
    """What is read back: the second append knows no status, which erases none."""
    return latest.load(telemetry_store(spark, d), "job_runs").select("run_id", "item_name", "status", "duration_seconds")


@query("""WITH s AS (SELECT 'delta_commits' AS dataset, max(ts) FILTER (event_type = 'click') AS seen, max(ts) AS t FROM events UNION ALL SELECT 'job_runs', max(ts) FILTER (event_type = 'purchase'), max(ts) FROM events UNION ALL SELECT 'landing_files', NULL, max(ts) FROM events),
g AS (SELECT *, (epoch_us(t) - epoch_us(seen)) / 60000000.0::DOUBLE AS missed FROM s) SELECT dataset, CASE WHEN seen IS NULL OR missed >= 6 THEN 'high' ELSE 'medium' END AS severity FROM g WHERE seen IS NULL OR missed >= 2""")
def stored_freshness(spark, d):
    """The freshness rule over the stores' own times of collection; each dataset is due every minute."""
    names = ["delta_commits", "job_runs", "landing_files"]
    want = spark.createDataFrame([(n, 1, "") for n in names], "dataset string, every_minutes bigint, workspace string")
    return freshness.detect(latest.last_collected(telemetry_store(spark, d), names), want, now(spark, d)).select(F.col("item_name").alias("dataset"), "severity")


@query(f"SELECT incident_id, proposal_target FROM ({_SPARSE}) WHERE proposal_target IS NOT NULL")
def reviewable(spark, d):
    return incidents.reviewable(sparse_store(spark, d)).select("incident_id", "proposal_target")


@query("SELECT CAST(min(event_id) AS VARCHAR) AS incident_id, 'medium' AS severity FROM events WHERE event_type = 'error'")
def one_incident(spark, d):
    view = sparse_store(spark, d)
    first = table(spark, d, "events").where("event_type = 'error'").agg(F.min("event_id")).first()[0]
    return incidents.get(view, str(first)).select("incident_id", "severity")


@query("""SELECT CAST(event_id AS VARCHAR) AS incident_id, CASE WHEN event_id % 2 = 0 THEN 'c' || event_id END AS diagnosis_cause, CASE WHEN event_id % 4 = 0 THEN 'none' END AS proposal_target FROM events WHERE event_type = 'error'""")
def recorded_rows(spark, d):
    """Incidents with what was found and proposed about them, as the store's columns."""
    e = table(spark, d, "events").where("event_type = 'error'")
    key = F.col("event_id").cast("string").alias("incident_id")
    found_, proposed = e.where("event_id % 2 = 0").select(key, F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("diagnosis_cause"), F.lit(1).alias("not stored")), e.where("event_id % 4 = 0").select(key, F.lit("none").alias("proposal_target"))
    return incidents.rows(e.select(key, F.col("props").alias("other")), found_, proposed)


@query("""SELECT CAST(event_id AS VARCHAR) AS incident_id, '[HIGH] r | item ' || user_id || ' | s' AS incident, CASE WHEN event_id % 3 > 0 THEN 'cause (low, model; cites run.id, run.status)' END AS diagnosis, CASE WHEN event_id % 3 = 1 THEN 'pipeline: do (unknown; cites )' END AS proposal FROM events WHERE event_type = 'error'""")
def readable(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    n = F.col("event_id")
    rows = e.select(
        n.cast("string").alias("incident_id"), F.lit("high").alias("severity"), F.lit("r").alias("rule"), F.concat(F.lit("item "), F.col("user_id").cast("string")).alias("item_name"), F.lit("s").alias("summary"), F.when(n % 3 > 0, "cause").alias("diagnosis_cause"), F.lit("low").alias("diagnosis_confidence"),
        F.lit("model").alias("diagnosis_source"), F.lit('["run.id","run.status"]').alias("diagnosis_cited_json"), F.when(n % 3 == 1, "pipeline").alias("proposal_target"), F.lit("do").alias("proposal_summary"), F.lit(None).cast("string").alias("proposal_confidence"), F.lit(None).cast("string").alias("proposal_cited_json"),
    )
    return incidents.readable(rows)


# ---- claims ----

_REPLIES = ('{"cause": "empty source", "confidence": "high", "evidence_cited": ["run.id"]}', 'I think: {"cause": "x", "evidence_cited": ["made.up"]} so', '{"cause": "undetermined", "reasoning": "unclear"}', '{"cause": ""}', "no json", '{"cause": "y", "evidence_cited": "run.id"}', '{"cause": "z", "evidence_cited": []}', "{broken}")
_OUTCOMES = (("empty source", "high", "model", ""), ("not diagnosed — measured facts only", "low", "fallback", "cites evidence that does not exist: made.up"), ("undetermined", "low", "abstention", ""), ("not diagnosed — measured facts only", "low", "fallback", "unparseable reply: reply has no 'cause'"), ("not diagnosed — measured facts only", "low", "fallback", "unparseable reply: no JSON object in reply"), ("not diagnosed — measured facts only", "low", "fallback", "unparseable reply: evidence_cited is not a list"), ("not diagnosed — measured facts only", "low", "fallback", "cites no evidence"), ("not diagnosed — measured facts only", "low", "fallback", "unparseable reply: malformed JSON"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query("WITH e AS (SELECT CAST(event_id AS VARCHAR) AS incident_id, event_id % 8 AS k FROM events) SELECT incident_id, " + ", ".join(f"CASE k {' '.join(f'WHEN {k} THEN {_quoted(o[i])}' for k, o in enumerate(_OUTCOMES))} END AS {name}" for i, name in enumerate(("cause", "confidence", "source", "reason"))) + " FROM e")
def parsed_replies(spark, d):
    reply = F.element_at(F.array(*(F.lit(r) for r in _REPLIES)), (F.col("event_id") % 8 + 1).cast("int"))
    blank = {k: F.lit(None).cast(kind) for k, kind, _ in evidence.FACTS}
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("incident_id"), reply.alias("reply"), F.lit("down").alias("unavailable"), *(c.alias(k) for k, c in blank.items()), F.array(F.lit("run.id")).alias("held"))
    return claims.diagnoses(e, "m", now(spark, d)).select("incident_id", F.col("diagnosis_cause").alias("cause"), F.col("diagnosis_confidence").alias("confidence"), F.col("diagnosis_source").alias("source"), F.col("fallback_reason").alias("reason"))


@query("""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS incident_id, event_id % 2 = 0 AS by_model, event_id % 3 AS k FROM events) SELECT incident_id, CASE WHEN by_model AND k = 0 THEN 'notebook' ELSE 'none' END AS target, CASE WHEN by_model AND k = 0 THEN 'do it' ELSE '' END AS change,
  CASE WHEN by_model AND k = 0 THEN 'model' WHEN by_model AND k = 1 THEN 'fallback' ELSE 'abstention' END AS source FROM e""")
def proposals(spark, d):
    n = F.col("event_id")
    reply = F.element_at(F.array(*(F.lit(r) for r in ('{"target": "notebook", "change": "do it", "evidence_cited": ["run.id"]}', '{"target": "notebook", "change": " ", "evidence_cited": ["run.id"]}', '{"target": "none"}'))), (n % 3 + 1).cast("int"))
    e = table(spark, d, "events").select(n.cast("string").alias("incident_id"), F.lit("c").alias("diagnosis_cause"), F.when(n % 2 == 0, "model").otherwise("fallback").alias("diagnosis_source"), F.array(F.lit("run.id")).alias("held"), reply.alias("reply"), F.lit(None).cast("string").alias("unavailable"))
    return claims.proposals(e, "m", now(spark, d)).select("incident_id", F.col("proposal_target").alias("target"), F.col("proposal_change").alias("change"), F.col("proposal_source").alias("source"))


# ---- text, profiles, further operators ----


@query("SELECT p_partkey, p_brand AS short, 'file ' || p_partkey || '.csv' AS name, 'lake/' || p_brand AS folder, p_brand || '#1' AS widened, (p_partkey % 7) AS weekday FROM part")
def text_functions(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.lit("lake/"), "p_brand", F.lit("/file "), F.col("p_partkey").cast("string"), F.lit(".csv"), F.when(F.col("p_partkey") % 2 == 0, "/").otherwise(""))
    monday = F.to_date(F.lit("2024-01-01"))
    return p.select("p_partkey", short_name(F.concat(F.lit("`a`.b.`"), "p_brand", F.lit("`"))).alias("short"), basename(path).alias("name"), parent(path).alias("folder"), widened(F.col("p_brand"), F.lit(1)).alias("widened"), weekday(F.date_add(monday, (F.col("p_partkey") % 7).cast("int"))).cast("bigint").alias("weekday"))


@query("SELECT o_orderkey AS k, CAST(o_orderkey // 4 + CASE WHEN o_orderkey % 4 = 3 OR o_orderkey % 4 = 2 AND (o_orderkey // 4) % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS half_even FROM orders")
def half_even(spark, d):
    """Quarters to whole numbers."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), rounded(F.col("o_orderkey") / 4, 0).alias("half_even"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def largest_by(spark, d):
    return profile.latest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM n WHERE i % greatest(1, n // 6) = 0 AND i // greatest(1, n // 6) < 6")
def every_nth(spark, d):
    return profile.every_nth(table(spark, d, "customer").select("c_custkey"), "c_custkey", 6)


@query("SELECT 'status_' || o_orderstatus AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY o_orderstatus")
def prefixed(spark, d):
    return profile.prefixed_counts(table(spark, d, "orders"), "o_orderstatus", "status")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 2, 3)")
def selected(spark, d):
    wanted = spark.createDataFrame([(1,), (2,), (3,), (3,)], "n_nationkey bigint")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    return profile.selected(n, wanted, "n_nationkey")


@query("SELECT user_id, event_id FROM events")
def all_null_columns(spark, d):
    e = table(spark, d, "events").select("user_id", F.lit(None).cast("string").alias("none"), "event_id", F.when(F.lit(False), 1).alias("never"))
    return store.drop_all_null_columns(e)


@query(f"WITH {_RUNS}, {_COMMITS}, b AS (SELECT item_name, run_id, start_time, value_seconds, avg(value_seconds) OVER w AS m, stddev_samp(value_seconds) OVER w AS s FROM (SELECT *, CAST(epoch_us(start_time) // 1000000 % 1000 AS DOUBLE) AS value_seconds FROM runs) WINDOW w AS (PARTITION BY item_name ORDER BY start_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)) SELECT run_id FROM b WHERE abs(value_seconds - m) > 1.25 * s")
def unusual_runs(spark, d):
    r = runs(spark, d).withColumns({"seconds": (F.unix_seconds("start_time") % 1000).cast("double"), "how": F.lit("Scheduled")})
    return extras.unusual(extras.rolling_baseline(r, "item_name", "start_time", "seconds", 30, "how"), "seconds", 1.25).select("run_id")


def model_refreshes(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    took = F.col("event_id") % 9 + 1
    return e.select(F.col("user_id").cast("string").alias("dataset_id"), F.col("event_id").cast("string").alias("refresh_id"), F.col("ts").alias("start_time"), (F.col("ts") + F.make_dt_interval(hours=took.cast("int"))).alias("end_time"), (took * 3600).cast("double").alias("duration_seconds"), F.when(F.col("value") < 20, "Failed").otherwise("Completed").alias("status"), F.when(F.col("value") < 20, F.concat(F.lit("Gateway "), F.when(F.col("event_id") % 2 == 0, "timed out").otherwise("refused"))).alias("error"))


_REFRESHES = "r AS (SELECT CAST(user_id AS VARCHAR) AS dataset_id, CAST(event_id AS VARCHAR) AS refresh_id, ts AS st, ts + INTERVAL 1 HOUR * (event_id % 9 + 1) AS en, CAST((event_id % 9 + 1) * 3600 AS DOUBLE) AS took, value, event_id FROM events WHERE event_type = 'view'), x AS (SELECT a.dataset_id, a.refresh_id, a.took, count(b.refresh_id) AS n FROM r a LEFT JOIN r b ON b.st <= a.en AND b.en >= a.st AND a.dataset_id <> b.dataset_id GROUP BY ALL)"


@query(f"WITH {_REFRESHES} SELECT dataset_id || '|' || refresh_id AS id, n FROM x")
def collisions(spark, d):
    return extras.collisions(model_refreshes(spark, d))


@query(f"WITH {_REFRESHES}, m AS (SELECT dataset_id, median(took) AS median FROM r GROUP BY 1) SELECT dataset_id, refresh_id, n, took AS duration_seconds, median FROM x JOIN m USING (dataset_id) WHERE n >= 3 AND took >= 1.5 * median")
def contention(spark, d):
    return extras.contention(model_refreshes(spark, d))


@query("SELECT CAST(event_id AS VARCHAR) AS refresh_id FROM events WHERE event_type = 'view' AND value < 20 AND event_id % 2 = 0")
def gateway_timeouts(spark, d):
    return extras.gateway_timeouts(model_refreshes(spark, d)).select("refresh_id")


@query("SELECT user_id, event_id FROM events WHERE event_type <> 'click'")
def uncounted(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return extras.uncounted(e, e.where("event_type = 'click'"), ["user_id", "event_id"]).select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND value >= 50 AND event_id % 3 > 0")
def findings(spark, d):
    e = table(spark, d, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "view", "PERFORMANCE").otherwise("Naming").alias("category"), F.when(F.col("value") >= 50, 2).otherwise(1).alias("severity"), F.when(F.col("event_id") % 3 == 0, "localdatetable_x").when(F.col("event_id") % 3 == 1, "Sales").alias("name"))
    return extras.findings(rows, F.col("category"), "severity", "name").select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 2 = 0")
def only_injected(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "injected").otherwise("discovered").alias("origin"))
    return extras.only_injected(e).select("event_id")


@query("""WITH e AS (SELECT o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS v FROM orders), b AS (SELECT s, p, CAST(sum(v) AS DOUBLE) AS change FROM e GROUP BY ALL)
SELECT s, p, change, round(sum(change) OVER (PARTITION BY s) * sum(change) OVER (PARTITION BY p) / nullif(sum(change) OVER (), 0), 6) AS expected FROM b""")
def interactions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.substring("o_orderpriority", 1, 1).alias("p"), F.lit(1.0).alias("one"), "o_orderkey")
    out = extras.interactions(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 <> 0"), "s", "p", "one")
    return out.withColumn("expected", F.round("expected", 6))


@query(f"WITH {_DELIVERED}, l AS (SELECT table_name, max(\"timestamp\") AS last FROM commits GROUP BY 1) SELECT run_id AS occurrence_key, epoch_us(last) AS last_us FROM del LEFT JOIN l ON l.table_name = del.item_name WHERE rows_delivered < 20")
def last_commit_measured(spark, d):
    m = F.from_json("measured_json", "last_commit_to_table timestamp")
    return found(spark, d).select("occurrence_key", micros(m["last_commit_to_table"]).alias("last_us"))


# ---- capacity, activity, model statistics ----


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, CAST(round(value * 100) AS BIGINT) AS v FROM events, range(4) r(k)), s AS (SELECT event_type, start, sum(v) AS total, count(*) AS n FROM w GROUP BY ALL)
SELECT event_type AS operation, epoch_us(start) AS start_us, CAST(total AS BIGINT) AS total, n FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY total DESC, start) = 1""")
def peak_capacity(spark, d):
    """Events as use of capacity through a store: the busiest hour of each operation."""
    s = new_store(spark)
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("item_id"), F.concat("event_type", F.lit("/"), F.col("event_id").cast("string")).alias("operation"), F.col("ts").alias("start_time"), F.round(F.col("value") * 100).alias("cu_seconds"))
    s.write("capacity_metrics", rows, datetime(2024, 3, 1, tzinfo=timezone.utc))
    use = latest.load(s, "capacity_metrics").select(F.substring_index("operation", "/", 1).alias("operation"), "start_time", F.col("cu_seconds").cast("bigint").alias("cu"))
    return extras.peaks(use, ["operation"], "start_time", "cu").select("operation", micros("start").alias("start_us"), "total", "n")


@query("""WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), i AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') SELECT CAST(i.event_id AS VARCHAR) AS incident_id, CAST(a.event_id AS VARCHAR) AS change FROM i ASOF LEFT JOIN a ON i.user_id = a.user_id AND i.ts >= a.ts""")
def last_activity(spark, d):
    e = table(spark, d, "events")
    did = e.where("event_type = 'click'").select(F.col("user_id").cast("string").alias("item_id"), F.col("ts").alias("happened_at"), F.lit("me").alias("user"), F.col("event_id").cast("string").alias("operation"), F.col("event_id").cast("string").alias("activity_id"))
    i = e.where("event_type = 'error'").select(F.col("event_id").cast("string").alias("incident_id"), F.col("user_id").cast("string").alias("item_id"), "ts")
    return extras.changes_before(did, i, "item_id", "happened_at", "ts").select("incident_id", "change")


@query(f"""WITH {_MONTHS}, p AS (SELECT t, v, count(DISTINCT l_partkey) AS n, count(*) * 8 AS size FROM m GROUP BY 1, 2), b AS (SELECT *, lag(n) OVER w AS before, lag(size) OVER w AS size_before FROM p WINDOW w AS (PARTITION BY t ORDER BY v)) SELECT CAST(t AS VARCHAR) AS dataset_id, n AS distinct_values, before FROM b WHERE n >= 2.0 * before AND size >= size_before""")
def model_growth(spark, d):
    p = months(spark, d).groupBy("t", "v").agg(F.count_distinct("l_partkey").alias("distinct_values"), (F.count("*") * 8).alias("size_bytes"))
    day = F.make_date(F.floor((F.col("v") - 1) / 12).cast("int"), ((F.col("v") - 1) % 12 + 1).cast("int"), F.lit(1))
    stats = p.select(F.col("t").cast("string").alias("dataset_id"), F.lit("t").alias("table_name"), F.lit("c").alias("column_name"), day.alias("measured_on"), "distinct_values", "size_bytes")
    return extras.model_growth(stats).select("dataset_id", "distinct_values", "before")
