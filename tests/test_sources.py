import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.sources import landing, wire
from vigil.sources.seal import Seal
from vigil.sources.snapshots import Snapshots, collect_commits
from vigil.sources.store import CatalogStore, Store, casts_needed, conform, drop_all_null_columns

T0 = datetime(2026, 10, 7, 12, tzinfo=UTC)


def test_store_appends_and_conforms(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    assert s.read("landing_files").count() == 0 and s.write("landing_files", [], T0) == 0 and not s.exists("landing_files")
    assert s.write("landing_files", [{"source_name": "a", "size_bytes": 1}], T0) == 1
    assert s.write("landing_files", spark.createDataFrame([("b", 2.0, "kept", T0 - timedelta(days=1))], "source_name string, size_bytes double, note string, collected_at timestamp"), T0) == 1
    got = {r.source_name: r for r in s.read("landing_files").collect()}
    assert got["a"].size_bytes == 1 and got["a"].note is None and got["b"].size_bytes == 2 and got["b"].note == "kept" and got["b"].exists is None
    assert got["a"].collected_at.replace(tzinfo=UTC) == T0 and got["b"].collected_at.replace(tzinfo=UTC) == T0 - timedelta(days=1) and (got["b"].ingest_batch, got["b"].ingest_seq) > (got["a"].ingest_batch, got["a"].ingest_seq)
    assert s.read("landing_files").schema["size_bytes"].dataType == T.LongType()
    assert s.write("undeclared", [{"x": 1}], T0) == 1 and [r.x for r in s.read("undeclared").collect()] == ["1"]


def test_catalog_store(spark):
    s = CatalogStore(spark, "t_sources_")
    try:
        assert s.read("items").count() == 0
        assert s.write("items", spark.createDataFrame([("i", 1)], "item_id string, item_name int"), T0) == 1
        assert s.write("items", spark.createDataFrame([("j",)], "item_id string"), T0) == 1
        assert {(r.item_id, r.item_name) for r in s.read("items").collect()} == {("i", "1"), ("j", None)}
    finally:
        spark.sql("DROP TABLE IF EXISTS t_sources_items")


def test_casts(spark):
    a, b = T.StructType.fromDDL("x int, y string, z double"), T.StructType.fromDDL("x bigint, y string, w int")
    assert casts_needed(a, b) == {"x": "bigint"}
    df = spark.createDataFrame([(1, "s", None)], a)
    assert conform(df, b).dtypes == [("x", "bigint"), ("y", "string"), ("w", "int"), ("z", "double")]
    assert drop_all_null_columns(df).columns == ["x", "y"] and drop_all_null_columns(df.limit(0)).columns == []


def test_snapshots(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/ledger")
    assert t.versions() == [] and t.history().count() == 0 and t.counts().count() == 0
    t.overwrite(spark.range(5), T0)
    t.append(spark.range(3), T0 + timedelta(hours=1))
    t.overwrite(t.read().where("id < 2"), T0 + timedelta(hours=2), "DELETE")
    t.overwrite(t.read().where("false"), T0 + timedelta(hours=3), "DELETE")
    assert t.versions() == [0, 1, 2, 3] and t.read().count() == 0 and t.read(1).count() == 8 and t.count_at(3) == 0 and t.count_at(9) is None
    with pytest.raises(ValueError):
        t.overwrite(spark.range(1).withColumnRenamed("id", "x"), T0)
    import shutil

    shutil.rmtree(tmp_path / "ledger" / "v00000001")
    assert t.count_at(1) is None
    rows = {r.version: r for r in collect_commits([t], T0, "w").collect()}
    assert {v: r.rows_added for v, r in rows.items()} == {0: 5, 1: None, 2: None, 3: -4} and rows[2].operation == "DELETE" and rows[0].metrics_rows is None


def test_landing(spark, tmp_path, monkeypatch):
    (tmp_path / "full.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "head.csv").write_text("a,b\n")
    d = f"file://{tmp_path}"
    got = {r.source_name: r for r in landing.collect(spark, {"full": f"{d}/full.csv/", "head": f"{d}/head.csv", "gone": f"{d}/gone.csv", "nowhere": f"{d}/no/x.csv"}, T0, "w").collect()}
    assert (got["full"].exists, got["full"].data_rows, got["full"].size_bytes) == (True, 2, 12) and (got["head"].exists, got["head"].data_rows) == (True, 0)
    for k in ("gone", "nowhere"):
        assert (got[k].exists, got[k].data_rows, got[k].size_bytes, got[k].modified_at) == (False, None, None, None)
    assert len({r.collected_at for r in got.values()}) == 1
    monkeypatch.setattr(landing, "COUNT_LIMIT", 11)
    [r] = landing.collect(spark, {"full": f"{d}/full.csv"}, T0).collect()
    assert r.exists and r.size_bytes == 12 and r.data_rows is None
    out = landing.write_batch(spark.createDataFrame([(1, 2)], "a int, b int"), f"{d}/batch", {"b": "bb"})
    assert spark.read.option("header", True).csv(out).columns == ["a", "bb"]


def test_wire(spark, tmp_path):
    page = {"value": [{"id": "i", "displayName": "Load", "type": "DataPipeline", "workspaceId": "w", "later": 1}, {"id": "r", "displayName": "Rep", "type": "Report", "workspaceId": "w"}]}
    (tmp_path / "items.json").write_text(json.dumps(page, indent=1))
    raw = wire.from_pages(spark, f"file://{tmp_path}/items.json", wire.ITEM)
    known = wire.items(raw, spark.createDataFrame([("w", "Work")], "id string, displayName string"))
    assert {(r.item_id, r.workspace_name) for r in known.collect()} == {("i", "Work"), ("r", "Work")}
    jobs = [
        ("1", "i", "2026-10-07T02:00:00Z", "2026-10-07T02:10:30"), ("2", "i", "2026-10-07T08:00:00", None), ("3", "i", None, None), ("4", "i", "2026-08-01T00:00:00Z", "2026-08-01T00:00:01Z"), ("5", "r", "2026-10-07T02:00:00Z", None),
    ]
    df = spark.createDataFrame([(a, b, None, None, "Completed", s, e, None) for a, b, s, e in jobs], wire.JOB)
    got = {r.run_id: r for r in wire.job_runs(df, known, F.lit("2026-10-08 00:00:00")).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].duration_seconds == 630.0 and got["2"].duration_seconds is None and got["2"].start_time == datetime(2026, 10, 7, 8)
    models = wire.datasets(spark.createDataFrame([("m", "M", None, None, None), ("n", "N", None, False, None)], wire.MODEL), F.lit("w"), F.lit("Work"))
    fresh = spark.createDataFrame([(d, "1", None, None, "Completed", "2026-10-07T08:00:00Z", "2026-10-07T08:02:30Z", None) for d in "mn"], "dataset_id string, " + wire.REFRESH)
    assert [(r.dataset_id, r.duration_seconds) for r in wire.refresh_runs(fresh, models, F.lit("2026-10-08 00:00:00")).collect()] == [("m", 150.0)]


def test_paging(spark):
    book = {("a", None): {"value": [{"id": 1}], "continuationToken": "t"}, ("a", "t"): {"value": [{"id": 2}]}}

    def fetch(path, token):
        if path == "none":
            raise wire.Unavailable(404)
        return book[path, token]

    assert [x["id"] for x in wire.pages(fetch, "a")] == [1, 2] and list(wire.pages(fetch, "none", (404,))) == []
    with pytest.raises(wire.Unavailable):
        list(wire.pages(fetch, "none"))
    reader = wire._Reader(T.StructType.fromDDL("id string, x string"), {"paths": "a\nnone", "absent": "404"}, fetch)
    assert [tuple(r) for p in reader.partitions() for r in reader.read(p)] == [(1, None), (2, None)]


def truth(spark, fault_id="f1"):
    from vigil.sources.seal import TRUTH

    return spark.createDataFrame([(fault_id, "c", "w", "load", "m", "s", T0, None, 1, {"a": "1"}, [])], TRUTH)


def test_seal(spark, tmp_path):
    s = Seal(spark, f"file://{tmp_path}/sealed")
    assert not s.exists() and not (tmp_path / "sealed").exists() and s.list_ids() == []
    s.store(truth(spark))
    s.store(truth(spark, "f0"))
    with pytest.raises(FileExistsError):
        s.store(truth(spark))
    assert s.exists() and s.list_ids() == ["f0", "f1"] and s.active().count() == 2 and s.window("f1")[1] is None
    end = T0 + timedelta(hours=4)
    with pytest.raises(ValueError):
        s.correct_reverted("f1", end, "evidence", T0)
    s.mark_reverted("f1", end)
    with pytest.raises(ValueError):
        s.mark_reverted("f1", end)
    with pytest.raises(ValueError):
        s.correct_reverted("f1", end, "  ", T0)
    s.correct_reverted("f1", end + timedelta(hours=1), " the logs ", T0)
    r = s.load("f1")
    assert r.reverted_at.replace(tzinfo=UTC) == end + timedelta(hours=1) and len(r.corrections) == 1 and r.corrections[0]["reason"] == "the logs" and r.corrections[0]["from"].startswith("2026-10-07T16")
    assert r.parameters == {"a": "1"} and r.mechanism == "m" and [x.fault_id for x in s.active().collect()] == ["f0"]
    s.discard("f0")
    assert s.list_ids() == ["f1"]
    with pytest.raises(KeyError):
        s.load("f0")


def test_detection_never_reads_the_seal():
    import ast
    from pathlib import Path

    root = Path(__file__).parents[1] / "vigil"
    for name in ("plans/silent_delivery.py", "plans/freshness.py", "plans/evidence.py", "plans/claims.py", "plans/incidents.py", "operators/latest.py"):
        names = [n.module or "" if isinstance(n, ast.ImportFrom) else " ".join(a.name for a in n.names) for n in ast.walk(ast.parse((root / name).read_text())) if isinstance(n, ast.Import | ast.ImportFrom)]
        assert not any("seal" in n or "faults" in n or "scoring" in n for n in names)


def test_landing_of_many_sources_is_one_job(spark, tmp_path):
    """Present, missing, header only, empty, of odd names, folders of files: one scan counts them all."""
    (tmp_path / "in").mkdir()
    want = {}
    for i in range(60):
        name = f"f {i}%.csv" if i % 7 == 0 else f"f{i}.csv"
        if i % 5:
            (tmp_path / "in" / name).write_text("a,b\n" + "".join(f"{k},{k}\n\n" for k in range(i % 4)) if i % 11 else "")
        want[str(i)] = (bool(i % 5), (i % 4 if i % 11 else 0) if i % 5 else None)
    (tmp_path / "in" / "many").mkdir()
    for k in range(3):
        (tmp_path / "in" / "many" / f"part-{k}.csv").write_text("a\n1\n2\n")
    sources = {str(i): f"file://{tmp_path}/in/" + (f"f {i}%.csv" if i % 7 == 0 else f"f{i}.csv") for i in range(60)} | {"many": f"file://{tmp_path}/in/many/", "again": f"file://{tmp_path}/in/many"}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("landing", "x")
    try:
        out = landing.collect(spark, sources, T0)
        assert len(tracker.getJobIdsForGroup("landing")) <= 3  # one query, however many sources: the listing, the scan and what it sums up
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    got = {r.source_name: (r.exists, r.data_rows) for r in out.collect()}
    assert got == want | {"many": (True, 6), "again": (True, 6)}


def test_an_unreadable_file_is_unknown_and_takes_no_other_with_it(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text("a\n1\n")
    (tmp_path / "bad.csv.gz").write_bytes(b"this is no archive")
    got = {r.source_name: (r.exists, r.data_rows) for r in landing.collect(spark, {n: f"file://{tmp_path}/{n}" for n in [*(f"{i}.csv" for i in range(5)), "bad.csv.gz"]}, T0).collect()}
    assert got == {**{f"{i}.csv": (True, 1) for i in range(5)}, "bad.csv.gz": (True, None)}


def test_a_stream_by_time_asks_for_what_is_new(spark, tmp_path):
    """The second run asks for nothing older than the first run's end, and a third without anything new asks for nothing."""
    log = tmp_path / "calls"

    def fetch(path, token):
        with open(log, "a") as f:
            f.write(f"{path} {token}\n")
        base, _, since = path.partition("?since=")
        rows = [{"id": f"{base}{h}", "startTime": f"2026-01-01T{h:02d}:00"} for h in range(24)]
        rows = [r for r in rows if r["startTime"] >= since] + [{"id": "none"}]  # the moment itself is answered again
        at = int(token or 0)
        return {"value": rows[at : at + 10]} | ({"continuationToken": str(at + 10)} if at + 10 < len(rows) else {})

    spark.dataSource.register(wire.since_source(fetch, "startTime", "runs_since"))

    def run(until):
        log.write_text("")
        stream = spark.readStream.format("runs_since").schema("id string, startTime string").option("paths", "a\nb").option("until", until).load()
        stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(set(log.read_text().split("\n")[:-1]))

    assert run("2026-01-01T09:30") == ["a 10", "a 20", "a None", "b 10", "b 20", "b None"]
    out = lambda: sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert out() == sorted(f"{p}{h}" for p in "ab" for h in range(10))
    again = run("2026-01-01T20:30")
    assert all("since=2026-01-01T09:30" in c for c in again) and out() == sorted(f"{p}{h}" for p in "ab" for h in range(21))
    assert run("2026-01-01T20:30") == [] and len(out()) == 42
    since = spark.read.format("runs_since").schema("id string, startTime string").option("paths", "a").option("since", "2026-01-01T21:00").option("until", "2026-01-02").load()
    assert sorted(r.id for r in since.collect()) == ["a22", "a23"]


def test_a_filter_reaches_the_calls(spark, tmp_path):
    log = tmp_path / "calls"

    def fetch(path, token):
        with open(log, "a") as f:
            f.write(f"{path}\n")
        return {"value": [{"id": str(h), "startTime": f"2026-01-01T{h:02d}:00"} for h in range(24)]}

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(wire.since_source(fetch, "startTime", "runs_pushed", pushed=True))
        df = spark.read.format("runs_pushed").schema("id string, startTime string").option("paths", "a").option("until", "2026-01-02").load()
        assert sorted(r.id for r in df.where("startTime > '2026-01-01T21:00'").collect()) == ["22", "23"]
        assert set(log.read_text().split()) == {"a?since=2026-01-01T21:00"}
        assert sorted(r.id for r in df.where("startTime >= '2026-01-01T21:00'").collect()) == ["21", "22", "23"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_schema_comes_before_the_data(spark, tmp_path):
    """A batch that breaks off leaves no rows; done again it is there once."""
    s = Store(spark, f"file://{tmp_path}/s")
    bad = spark.range(1).select(F.lit("i").alias("item_id"), F.raise_error(F.lit("broken")).cast("string").alias("item_name"))
    with pytest.raises(Exception, match="broken"):
        s.write("items", bad, T0)
    assert s.read("items").count() == 0 and s.write("items", [{"item_id": "i"}], T0) == 1 and s.read("items").count() == 1
    assert [r.ingest_batch for r in s.read("items").select("ingest_batch").collect()] == [1]
