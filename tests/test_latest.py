from datetime import UTC, datetime, timedelta

import pytest

from vigil.operators import latest as L
from vigil.operators import versions as V
from vigil.sources.store import Store

T0 = datetime(2026, 10, 7, 12, tzinfo=UTC)
OBS = "k string, status string, duration double, collected_at timestamp"


def collapse(spark, rows, keys=("k",), schema=OBS):
    return L.latest_known(spark.createDataFrame(rows, schema), list(keys))


def row(status, duration, minutes, k="a"):
    return (k, status, duration, T0 + timedelta(minutes=minutes))


@pytest.mark.parametrize("flip", [False, True])
def test_newest_known_value_of_each_column(spark, flip):
    cases = [
        ([row("InProgress", None, 0), row("Completed", 22.0, 5)], ("Completed", 22.0)),
        ([row("Completed", 5000.0, 0), row("Completed", None, 5)], ("Completed", 5000.0)),
        ([row("x", 10.0, 0), row(None, 5000.0, 5)], ("x", 5000.0)),
        ([row(None, None, 0), row(None, None, 5)], (None, None)),
        ([row("late", None, 9), row("early", 1.0, 1)], ("late", 1.0)),
    ]
    for rows, want in cases:
        [got] = collapse(spark, rows[::-1] if flip else rows).collect()
        assert (got.status, got.duration) == want and got.collected_at.replace(tzinfo=UTC) == max(r[3] for r in rows)


def test_keys(spark):
    rows = [row("a", 1.0, 0, None), row("b", None, 1, None), row("c", 2.0, 0, "x")]
    assert {(r.k, r.status, r.duration) for r in collapse(spark, rows).collect()} == {(None, "b", 1.0), ("x", "c", 2.0)}
    with pytest.raises(KeyError):
        collapse(spark, rows, ["nope"])
    only = spark.createDataFrame([("x",), ("x",)], "k string")
    assert L.latest_known(only, ["k"]).count() == 1
    seq = spark.createDataFrame([("x", 1, 5), ("x", 2, 7)], "k string, v int, ingest_seq bigint")
    assert [r.v for r in L.latest_known(seq, ["k"]).collect()] == [2]


def test_ties_go_to_the_later_arrival(spark):
    df = spark.createDataFrame([("a", "second", T0, 2), ("a", "first", T0, 1)], "k string, status string, collected_at timestamp, ingest_seq bigint")
    assert L.latest_known(df, ["k"]).first().status == "second"


def test_repeating_a_batch_changes_nothing(spark):
    rows = [row("a", 1.0, 0), row(None, 2.0, 1), row("b", None, 0, "z")]
    once, twice = collapse(spark, rows), collapse(spark, rows * 2).repartition(3)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_store_views(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.write("delta_commits", [{"workspace_name": "w", "table_name": "t", "version": 1, "rows_added": 5000}], T0)
    s.write("delta_commits", [{"workspace_name": "w", "table_name": "t", "version": 1, "rows_added": None}, {"workspace_name": "w", "table_name": "u", "version": 1, "rows_added": 7}], T0 + timedelta(minutes=5))
    assert {(r.table_name, r.rows_added) for r in L.load(s, "delta_commits").collect()} == {("t", 5000), ("u", 7)}
    assert {tuple(r) for r in L.counts(s, ["delta_commits", "items"]).collect()} == {("delta_commits", 3, 2), ("items", 0, 0)}
    seen = {r.dataset: r.seen for r in L.last_collected(s, ["delta_commits", "items"]).collect()}
    assert seen["items"] is None and seen["delta_commits"].replace(tzinfo=UTC) == T0 + timedelta(minutes=5)
    assert L.complete_until(L.load(s, "delta_commits"), T0).first().cutoff.replace(tzinfo=UTC) == T0 - timedelta(minutes=5)
    assert L.complete_until(s.read("items"), T0).first().cutoff.replace(tzinfo=UTC) == T0 - timedelta(minutes=10)


def test_naive_times_are_labelled(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2026-10-07 12:00:00' AS t, 1 AS x")
    out = L.as_utc(df)
    assert dict(out.dtypes) == {"t": "timestamp", "x": "int"} and out.selectExpr("unix_seconds(t)").first()[0] == int(T0.timestamp())


def test_rows_added(spark):
    rows = [("a", 0, 5), ("a", 1, 9), ("a", 3, 4), ("a", 4, None), ("a", 5, 6), ("b", 7, 3), ("b", 8, 3)]
    df = spark.createDataFrame(rows, "table_name string, version bigint, n bigint")
    got = {(r.table_name, r.version): r.rows_added for r in V.rows_added(df).collect()}
    assert got == {("a", 0): 5, ("a", 1): 4, ("a", 3): -5, ("a", 4): None, ("a", 5): None, ("b", 7): None, ("b", 8): 0}
    few = {(r.table_name, r.version): r.rows_added for r in V.rows_added(df, 1).collect()}
    assert few[("a", 1)] is None and few[("b", 8)] == 0
