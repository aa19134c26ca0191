from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.plans import freshness as G
from vigil.plans import silent_delivery as S

NOW = datetime(2026, 10, 7, 12, tzinfo=UTC)
RUNS = "workspace_name string, item_name string, item_type string, run_id string, status string, start_time timestamp, end_time timestamp, duration_seconds double"
COMMITS = "workspace_name string, table_name string, version bigint, timestamp timestamp, operation string, rows_added bigint"


def at(x):
    return F.lit(x.isoformat()).cast("timestamp")


def run_row(start, run_id="r1", name="load", status="Completed", seconds=22.0, ended=True):
    return ("w", name, "DataPipeline", run_id, status, start, start + timedelta(seconds=seconds or 22) if ended else None, seconds)


def commit_row(ts, rows, table="ledger", version=1):
    return ("w", table, version, ts, "WRITE", rows)


def detect(spark, runs, commits, minimum=1, cutoff=NOW, given=None):
    expected = S.expectations(spark, given if given is not None else [S.WriteExpectation("load", "ledger", "w", minimum)])
    out = S.detect(spark.createDataFrame(runs, RUNS), spark.createDataFrame(commits, COMMITS), expected, at(cutoff), at(NOW))
    m = F.from_json("measured_json", "rows_delivered bigint, run_started string, last_commit_to_table string, run_duration_seconds double").alias("m")
    return out.select("*", m).select("*", "m.*").collect()


START = NOW - timedelta(hours=1)


@pytest.mark.parametrize(
    "commits, minimum, delivered, text",
    [
        ([(15, 0)], 1, 0, "wrote no rows"),
        ([], 1, 0, "wrote no rows"),
        ([(15, 12)], 4000, 12, "Delivery is partial"),
        ([(15, 12)], 1, None, ""),
        ([(15, None)], 1, None, ""),
        ([(15, None), (16, 0)], 1, None, ""),
        ([(80, 5000)], 1, None, ""),
        ([(112, 5000)], 1, None, ""),
        ([(113, 5000)], 1, 0, "wrote no rows"),
        ([(-90, 5000)], 1, None, ""),
        ([(-91, 5000)], 1, 0, "wrote no rows"),
        ([(5, 2500), (9, 2500)], 4000, None, ""),
        ([(5, 2500), (9, 1499)], 4000, 3999, "only 3,999 rows to ledger, below the expected 4,000"),
    ],
)
def test_deliveries(spark, commits, minimum, delivered, text):
    got = detect(spark, [run_row(START)], [commit_row(START + timedelta(seconds=s), n, version=i) for i, (s, n) in enumerate(commits)], minimum)
    assert [r.rows_delivered for r in got] == ([] if delivered is None else [delivered])
    for r in got:
        assert text in r.summary and r.severity == "high" and r.occurrence_key == "r1" and r.run_started == START.isoformat()


@pytest.mark.parametrize("row", [run_row(START, status="Failed"), run_row(START, status="InProgress", ended=False, seconds=None), run_row(START, name="other"), run_row(NOW - timedelta(seconds=22)), run_row(START, status=None)])
def test_runs_that_are_not_judged(spark, row):
    assert detect(spark, [row], []) == []


def test_many_runs_and_stable_ids(spark):
    runs = [run_row(NOW - timedelta(hours=h), f"r{h}") for h in range(1, 24)]
    commits = [commit_row(NOW - timedelta(hours=h) + timedelta(seconds=15), 0, version=h) for h in range(1, 24)]
    a, b = detect(spark, runs, commits), detect(spark, runs[::-1], commits[::-1])
    assert len(a) == 23 == len({r.incident_id for r in a}) and {r.incident_id for r in a} == {r.incident_id for r in b}
    import hashlib

    assert {r.incident_id for r in a} == {"INC-" + hashlib.sha1(f"silent_zero_row|w|load|r{h}".encode()).hexdigest()[:10] for h in range(1, 24)}


def test_each_expectation_alone_and_empties(spark):
    given = [S.WriteExpectation("load", "ledger", "w"), S.WriteExpectation("load", "clients", "w")]
    got = detect(spark, [run_row(START)], [commit_row(START, 5)], given=given)
    assert [(r.rows_delivered, r.last_commit_to_table) for r in got] == [(0, None)]
    assert detect(spark, [], []) == [] and detect(spark, [run_row(START)], [], given=[]) == []
    [r] = detect(spark, [(*run_row(START)[:7], None)], [])
    assert "in" not in r.summary.split(" but ")[0] and r.run_duration_seconds is None
    bad = S.unresolved(spark.createDataFrame([run_row(START)], RUNS), spark.createDataFrame([], COMMITS), S.expectations(spark, given))
    assert sorted(map(tuple, bad.collect())) == [("table", "clients"), ("table", "ledger")]


GAP_NOW = datetime(2026, 10, 14, 18, tzinfo=UTC)


def gaps(spark, seen, every=60, name="job_runs"):
    df = spark.createDataFrame([(name, seen)] if seen != "absent" else [], "dataset string, seen timestamp")
    out = G.detect(df, G.expectations(spark, [G.CollectionExpectation(name, every, "w")]), at(GAP_NOW))
    m = F.from_json("measured_json", "gap_hours double, intervals_missed double, last_collected_at string").alias("m")
    return out.select("*", m).select("*", "m.*").collect()


@pytest.mark.parametrize("minutes, every, severity", [(5, 60, None), (90, 60, None), (119, 60, None), (120, 60, "medium"), (180, 60, "medium"), (359, 60, "medium"), (360, 60, "high"), (600, 60, "high"), (360, 1440, None), (38 * 60, 60, "high")])
def test_gaps(spark, minutes, every, severity):
    got = gaps(spark, GAP_NOW - timedelta(minutes=minutes), every)
    assert [r.severity for r in got] == ([severity] if severity else [])
    for r in got:
        assert r.gap_hours == round(minutes / 60, 2) and r.intervals_missed == round(minutes / every, 1)


def test_never_and_one_id_an_outage(spark):
    for seen in (None, "absent"):
        [r] = gaps(spark, seen)
        assert (r.severity, r.occurrence_key, r.gap_hours) == ("high", "job_runs|never", None)
    [a] = gaps(spark, GAP_NOW - timedelta(hours=38))
    [b] = gaps(spark, GAP_NOW - timedelta(hours=39))
    assert a.incident_id != b.incident_id and a.occurrence_key == f"job_runs|{(GAP_NOW - timedelta(hours=38)).isoformat()}" and "38.0 hours ago" in a.summary
    odd = GAP_NOW - timedelta(hours=9, microseconds=5)
    [c] = gaps(spark, odd)
    assert c.last_collected_at == odd.isoformat()
