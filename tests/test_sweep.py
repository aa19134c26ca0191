"""Joins over time against all pairs: next values, what points and windows make of each other, savings; and what their plans hold."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.operators import extras as X
from vigil.operators import intervals as I
from vigil.plans import scoring

T0 = datetime(2026, 1, 1)
AT = "id long, k string, t timestamp, v long"


def points(n=150, seed=2, keys=("a", "a", "a", "b", None)):
    rng = random.Random(seed)
    return [(i, rng.choice(keys), rng.choice([None] + [T0 + timedelta(hours=rng.randrange(200)) for _ in range(9)]), rng.randrange(9)) for i in range(n)]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("arrival", [None, ["id"]])
def test_as_of_both_ways(spark, forward, arrival):
    left, right = points(60, 1), points(200, 2)
    got = {r.id: r.v2 for r in I.as_of(spark.createDataFrame(left, AT).drop("v"), spark.createDataFrame(right, "id long, k string, at timestamp, v2 long"), ["k"], "t", "at", ["v2"], forward, arrival, 7200).collect()}
    want = {}
    for i, k, t, _ in left:
        there = [(abs(r[2] - t), r[0] if arrival else 0, r[3]) for r in right if t and r[2] and r[1] == k and (r[2] >= t if forward else r[2] <= t)]
        want[i] = min(there)[2] if there else None
    assert got == want


def windows(n=40, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = T0 + timedelta(hours=rng.randrange(200))
        out.append((f"f{i}", rng.choice(["a", "a", "b", "c", None]), rng.choice([s, s, s, None]), rng.choice([None, s, s + timedelta(hours=rng.randrange(60)), s - timedelta(hours=1)])))
    return out


def held(p, w, now):
    return [x for x in p if w[1] is not None and x[1] == w[1] and x[2] and w[2] and w[2] <= x[2] <= (w[3] or now)]


@pytest.mark.parametrize("bin_seconds", [3600, 86400, 10**9])
def test_swept_against_all_pairs(spark, bin_seconds):
    now = T0 + timedelta(hours=150)
    p, w = points(), windows()
    done = I.swept(spark.createDataFrame(p, AT), spark.createDataFrame(w, "f string, k string, s timestamp, e timestamp"), "k", "t", "s", F.coalesce("e", F.lit(now)), bin_seconds).collect()
    assert sorted(r.point.id for r in done if r.side == 0) == [x[0] for x in p]
    assert {r.point.id: r.open for r in done if r.side == 0} == {x[0]: sum(x in held(p, y, now) for y in w) for x in p}
    ends = {(r.window.f, r.side): r for r in done if r.side}
    assert len(ends) == 2 * len(w)
    for y in w:
        mine = held(p, y, now)
        assert ends[y[0], 2].seen - ends[y[0], 1].seen == len(mine)
        first = ends[y[0], 1].next
        assert (first if first and first <= (y[3] or now) else None) == (min(x[2] for x in mine) if mine else None)


def incidents(spark, p):
    f = spark.createDataFrame(p, AT)
    pick = lambda m, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.col("id") % m + 1).cast("int"))
    return f.select(F.col("id").cast("string").alias("incident_id"), F.col("k").alias("item_name"), F.to_json(F.struct(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("run_started"))).alias("measured_json"), pick(3, "c", None, "x").alias("diagnosis_cause"), pick(3, "model", None, "fallback").alias("diagnosis_source"), pick(4, "correct", None, "partial", None).alias("verdict"), pick(2, None, "approved").alias("decision"), F.lit(None).cast("string").alias("proposal_target"))


def faults(spark, w):
    return spark.createDataFrame(w, "fault_id string, target_item string, injected_at timestamp, reverted_at timestamp")


def test_scoring_against_all_pairs(spark):
    now = T0 + timedelta(hours=150)
    p, w = points(), windows()
    i, f = incidents(spark, p), faults(spark, w)
    inside = {x[0] for y in w for x in held(p, y, now)}
    assert {int(r.incident_id) for r in scoring.unmatched(i, f, F.lit(now)).collect()} == {x[0] for x in p} - inside
    late = {r.fault_id: (r.n, r.latency_hours) for r in scoring.latency(i, f, F.lit(now)).collect()}
    want = {y[0]: (len(m := held(p, y, now)), min((x[2] - y[2]).total_seconds() / 3600 for x in m) if m else None) for y in w}
    assert late == want
    got = {r.metric: r.value for r in scoring.results(i, f, F.lit(now)).collect()}
    hours = sorted(v[1] for v in want.values() if v[0])
    judged = {x[0] for x in p if x[0] % 4 in (0, 2)}
    assert got["incidents_matched"] == sum(v[0] for v in want.values()) and got["faults_detected"] == len(hours) and got["faults_missed"] == len(w) - len(hours)
    assert got["latency_hours_median"] == hours[len(hours) // 2] and got["latency_hours_worst"] == hours[-1]
    assert got["judged_against_seal"] == len(judged & inside) and got["judged_without_seal"] == len(judged - inside) and got["incidents_unmatched"] == len(p) - len(inside)
    assert got["verdict_correct"] + got["verdict_partial"] == len(judged & inside)


def test_nothing_to_score(spark):
    none = incidents(spark, points()).limit(0)
    got = {r.metric: r.value for r in scoring.results(none, faults(spark, windows()), F.lit(T0)).collect()}
    assert got["incidents_total"] == 0 and got["faults_sealed"] == 40 == got["faults_missed"] and got["latency_hours_median"] is None
    got = {r.metric: r.value for r in scoring.results(none, faults(spark, []), F.lit(T0)).collect()}
    assert got["faults_sealed"] == 0 and got["latency_hours_worst"] is None and set(scoring.COUNTED) <= set(got)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def made_rows(df):
    """The most rows that a join of the plan that ran has made, and the scans in it."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    most, todo = 0, [plan.executedPlan() if hasattr(plan, "executedPlan") else plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        for stage in ("plan", "child"):
            if kind.endswith("QueryStageExec") and stage == "plan":
                todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


@pytest.mark.parametrize("of", [scoring.unmatched, scoring.latency, scoring.results, scoring.table])
def test_a_hot_item_makes_no_pairs(spark, tmp_path, of):
    """All incidents and faults are of one item, and each window holds about half of all incidents."""
    n = 3000
    spark.range(n).select(F.col("id"), F.lit("hot").alias("k"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id") * 10)).alias("t"), F.lit(1).cast("bigint").alias("v")).write.parquet(f"file://{tmp_path}/i")
    spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("fault_id"), F.lit("hot").alias("target_item"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id") * 10)).alias("injected_at"), F.lit(None).cast("timestamp").alias("reverted_at")).write.parquet(f"file://{tmp_path}/f")
    raw = spark.read.parquet(f"file://{tmp_path}/i")
    i = raw.select(F.col("id").cast("string").alias("incident_id"), F.col("k").alias("item_name"), F.to_json(F.struct(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("run_started"))).alias("measured_json"), *(F.lit("x").alias(c) for c in ("diagnosis_cause", "diagnosis_source", "verdict", "decision", "proposal_target")))
    out = of(i, spark.read.parquet(f"file://{tmp_path}/f"), F.lit(T0 + timedelta(days=90)))
    assert made_rows(out) <= 3 * n  # pairs would be 4.5 million
    plan = plan_of(out)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert len(re.findall(r"FileScan parquet", plan)) == 2  # incidents once, faults once


def test_savings_against_all_pairs(spark):
    p, c = points(300, 8), points(40, 9)
    df, changes = spark.createDataFrame(p, AT), spark.createDataFrame(c, "id long, k string, changed timestamp, v long").select("k", "changed")
    got = {(r.k, r.changed): (r.before, r.after) for r in X.saving(df, changes, "k", "t", "v", "changed", 24).collect()}
    mean = lambda x: sum(x) / len(x) if x else None
    want = {}
    for _, k, at, _ in c:
        near = [(x[2], x[3]) for x in p if k is not None and at and x[1] == k and x[2] and abs(x[2] - at) <= timedelta(hours=24)]
        want[k, at] = mean([v for t, v in near if t < at]), mean([v for t, v in near if t >= at])
    assert got == want
