"""What a store, a landing folder and interval operators do with many partitions, hot keys and new columns."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vigil.operators import intervals, latest
from vigil.plans import datagen, faults, silent_delivery
from vigil.sources import landing, snapshots, store, wire

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_arrival_order_beyond_many_partitions(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    rows = spark.range(0, 2000, 1, 200).select(F.lit("i1").alias("item_id"), F.col("id").cast("string").alias("item_name"))
    s.write("items", rows, T0)
    got = s.read("items")
    assert got.select("ingest_batch", "ingest_seq").distinct().count() == 2000
    assert [int(r.item_name) for r in got.orderBy("ingest_batch", "ingest_seq").collect()] == list(range(2000))
    s.write("items", [{"item_id": "i1", "item_name": "last"}], T0)
    assert latest.load(s, "items").first().item_name == "last"


def test_batch_numbers_are_taken_once(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert [s._take_batch("items") for _ in range(3)] == [0, 1, 2]


@pytest.mark.parametrize("kind", ["files", "catalog"])
def test_new_columns_join_the_schema(spark, tmp_path, kind):
    s = store.Store(spark, f"file://{tmp_path}/s") if kind == "files" else store.CatalogStore(spark, "merge_")
    first = spark.createDataFrame([("a", "x")], "item_id string, item_name string")
    assert s.write("items", first, T0) == 1
    assert s.write("items", first.withColumns({"extra": F.lit(5), "item_name": F.lit(7)}), T0 + timedelta(hours=1)) == 1
    assert s.write("items", first.limit(0), T0) == 0
    assert sorted((r.item_name, r.extra) for r in s.read("items").collect()) == [("7", 5), ("x", None)]
    assert latest.load(s, "items").first().extra == 5


def test_a_written_batch_is_one_file_that_the_fault_cuts(spark, tmp_path):
    path = f"file://{tmp_path}/in/day.csv"
    landing.write_batch(datagen.landing_batch(spark, 50), path)
    [row] = landing.collect(spark, {"day": path}, T0).collect()
    assert row.exists and row.data_rows == 50 and row.size_bytes > 1000
    fault = faults.SilentZeroRow(spark, "w", "load", path=path)
    fault.apply(T0)
    assert landing.collect(spark, {"day": path}, T0).first().data_rows == 0
    fault.undo(T0)
    assert landing.collect(spark, {"day": path}, T0).first().data_rows == 50
    read = landing.read_csv(spark, path, ["PostedTimestamp"])
    assert dict(read.dtypes)["PostedTimestamp"] == "timestamp" and read.where("PostedTimestamp is null").isEmpty()


def test_an_append_keeps_what_is_written(spark, tmp_path):
    t = snapshots.Snapshots(spark, f"file://{tmp_path}/t")
    t.append(spark.range(5), T0)
    t.append(spark.range(5, 8), T0)
    t.overwrite(spark.range(2), T0)
    t.append(spark.range(1), T0)
    assert [t.read(v).count() for v in range(4)] == [5, 8, 2, 3] == [t.count_at(v) for v in range(4)]
    assert spark.read.parquet(f"{tmp_path}/t/v00000001").count() == 3
    bad = snapshots.Snapshots(spark, f"file://{tmp_path}/bad")
    bad.append(spark.range(1), T0)
    (tmp_path / "bad/_log/00000000.json").write_text("{broken")
    got = snapshots.collect_commits([bad, t], T0).orderBy("version").collect()
    assert [(r.table_name, r.rows_added) for r in got] == [("t", 5), ("t", 3), ("t", -6), ("t", 1)]
    assert snapshots.collect_commits([bad], T0).count() == 0


def test_interval_totals_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(2)
    at = lambda: T0 + timedelta(minutes=rng.randrange(0, 8000))
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    points = [(key(), at() if rng.random() > 0.05 else None, rng.choice([None, 1, 2, 5])) for _ in range(600)]
    spans = [(i, key(), s, rng.choice([None, s - timedelta(minutes=5), s, s + timedelta(minutes=rng.randrange(3000))])) for i in range(120) for s in [at()]]
    p = spark.createDataFrame(points, "k string, ts timestamp, v long").withColumn("none", F.col("v").isNull().cast("int"))
    q = spark.createDataFrame(spans, "i long, k string, s timestamp, e timestamp")
    want = {i: (sum(v or 0 for a, t, v in m), sum(v is None for a, t, v in m)) for i, k, s, e in spans for m in [[x for x in points if k is not None and x[0] == k and x[1] is not None and e is not None and s <= x[1] <= e]]}
    for seconds in (600, 86_400):
        got = intervals.interval_totals(p, q, ["k"], "ts", "s", "e", ["v", "none"], seconds)
        assert {r.i: (r.v, r.none) for r in got.collect()} == want


def test_no_run_meets_the_commits_of_its_table_and_no_rows_meet_in_one_task(spark):
    n = 3000
    commits = spark.range(n).select(F.lit("w").alias("workspace_name"), F.lit("hot").alias("table_name"), F.timestamp_seconds(F.col("id") * 600).alias("timestamp"), F.lit(1).cast("bigint").alias("rows_added"))
    runs = spark.range(n).select(F.lit("w").alias("workspace_name"), F.lit("p").alias("item_name"), F.col("id").cast("string").alias("run_id"), F.lit("Completed").alias("status"), F.timestamp_seconds(F.col("id") * 600).alias("start_time"), F.timestamp_seconds(F.col("id") * 600 + 60).alias("end_time"), F.lit(60.0).alias("duration_seconds"))
    expected = silent_delivery.expectations(spark, [silent_delivery.WriteExpectation("p", "hot", "w", 1)])
    out = silent_delivery.deliveries(runs, commits, expected, F.lit("2100-01-01").cast("timestamp"))
    assert out.count() == n and out.where("rows_delivered <> 1").isEmpty()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hot" in plan and plan.count("SinglePartition") == 0 and "__bin" in plan


def test_nested_scans(spark):
    def fetch(path, token):
        if path == "workspaces":
            return {"value": [{"id": "w1", "displayName": "One"}], "continuationToken": "x"} if token is None else {"value": [{"id": "w2", "displayName": "Two"}]}
        if path.endswith("/items"):
            w = path.split("/")[1]
            return {"value": [{"id": f"{w}-p", "displayName": "load", "type": "DataPipeline"}, {"id": f"{w}-r", "displayName": "r", "type": "Report"}]}
        if path.endswith("/jobs/instances"):
            if "w2" in path:
                raise wire.Unavailable(404)
            return {"value": [{"id": "j1", "jobType": "Pipeline", "status": "Completed", "startTimeUtc": "2026-01-01T02:00:00", "endTimeUtc": "2026-01-01T02:10:30Z", "failureReason": {"code": 1}}, {"id": "old", "startTimeUtc": "2020-01-01T00:00:00Z"}, {"id": "open", "startTimeUtc": None}]}
        if path == "groups":
            return {"value": [{"id": "w1", "name": "One"}]}
        if path.endswith("/datasets"):
            return {"value": [{"id": "d1", "name": "m", "isRefreshable": None}, {"id": "d2", "name": "n", "isRefreshable": False}]}
        assert path.endswith(f"/refreshes?$top={wire.MOST_REFRESHES}") and "d1" in path
        return {"value": [{"id": f"r{i}", "status": "Completed", "startTime": "2026-01-01T08:00:00Z", "endTime": "2026-01-01T08:02:30Z"} for i in range(90)]}

    now = F.lit("2026-01-03 00:00:00")
    got = {r.run_id: r for r in wire.scan_job_runs(spark, fetch, now).collect()}
    assert set(got) == {"j1", "open"} and got["j1"].duration_seconds == 630.0 and json.loads(got["j1"].failure_reason) == {"code": 1} and got["j1"].workspace_name == "One"
    r = wire.scan_refresh_runs(spark, fetch, now)
    assert r.count() == wire.MOST_REFRESHES and r.first().duration_seconds == 150.0 and r.first().dataset_name == "m"


def test_repayments_are_numbered_from_one(spark, monkeypatch):
    from datetime import date

    monkeypatch.setattr(datagen, "NUMBERED", 100)
    facts = datagen.ledger(spark, 900, 1, date(2026, 1, 1), date(2026, 1, 31), first=50)
    ids = [r.RepaymentID for r in datagen.repayments(facts, 900, 1).orderBy("TransactionID").collect()]
    assert ids == [f"RPY-{i:010d}" for i in range(1, 301)]
