import random
from datetime import datetime, timedelta

from vigil.operators import extras as X
from vigil.operators import intervals as I
from vigil.operators import profile as P

T0 = datetime(2026, 1, 1)


def test_overlap_against_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        s = T0 + timedelta(minutes=rng.randrange(3000))
        rows.append((i, rng.choice(["a", "b", None]), s, s + timedelta(minutes=rng.choice([0, 5, 200, 900]))))
    rows += [(90, "a", None, T0), (91, "a", T0, None), (92, "a", T0 + timedelta(hours=1), T0)]
    df = spark.createDataFrame(rows, "id long, item string, start timestamp, end timestamp")
    for width in (600, 3600, 86400):
        got = {r.id: r.n for r in I.overlap_counts(df, df, "id", bin_seconds=width).collect()}
        ok = [r for r in rows if r[2] and r[3] and r[2] <= r[3]]
        assert got == {r[0]: sum(o[2] <= r[3] and o[3] >= r[2] and not (o[1] == r[1]) for o in ok) if r in ok else 0 for r in rows}


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", T0), (2, "a", T0 + timedelta(days=2)), (3, "b", T0), (4, "a", None), (5, "c", T0)], "id long, k string, t timestamp")
    right = spark.createDataFrame([("a", T0, 1), ("a", T0 + timedelta(days=1), 2), ("a", T0 + timedelta(days=3), 3), ("b", T0 + timedelta(seconds=1), 4), ("c", T0, 7), ("c", T0, 5)], "k string, at timestamp, v int")
    assert {r.id: r.v for r in I.as_of(left, right, ["k"], "t", "at", ["v"]).collect()} == {1: 1, 2: 2, 3: None, 4: None, 5: 5}
    got = {r.id: r.v for r in I.as_of(left.where("t is not null"), right.where("k = 'a'"), [], "t", "at", ["v"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 5: 1}


def test_islands_and_profile(spark):
    df = spark.createDataFrame([("a", T0), ("a", T0 + timedelta(hours=6)), ("a", T0 + timedelta(hours=12, seconds=1)), ("b", T0)], "k string, t timestamp")
    assert sorted((r.k, r.island, r.n) for r in X.island_spans(df, ["k"], "t", "6 HOURS").collect()) == [("a", 0, 2), ("a", 1, 1), ("b", 0, 1)]
    assert [tuple(r) for r in P.value_counts(df.union(df.selectExpr("null", "t").limit(1)), "k").collect()] == [("a", 3), ("b", 1), (None, 1)]
    assert [(r.column, r.distinct_values) for r in P.cardinalities(df).collect()] == [("t", 3), ("k", 2)]
    assert P.cardinalities(df.limit(0)).where("share is not null").count() == 0
    assert [r.t for r in P.every_nth(df.where("k = 'a'"), "t", 2).collect()] == [T0, T0 + timedelta(hours=6)]


def test_contributions(spark):
    now = spark.createDataFrame([("x", 10.0), ("y", 1.0), ("n", 2.0)], "d string, v double")
    then = spark.createDataFrame([("x", 4.0), ("y", 3.0), ("gone", 1.0)], "d string, v double")
    got = {r.d: (r.change, round(r.share, 3), r.mixed) for r in X.contributions(now, then, "d", "v").collect()}
    assert got == {"x": (6.0, 0.545, True), "y": (-2.0, 0.182, True), "n": (2.0, 0.182, True), "gone": (-1.0, 0.091, True)}
    same = {r.d: r.share for r in X.contributions(now, now.selectExpr("d", "v - 1 as v"), "d", "v").collect()}
    assert all(abs(s - 1 / 3) < 1e-9 for s in same.values())
    assert X.drill(now, then, ["d"], "v")[0][0] == "d"


def test_staleness(spark):
    rows = [("a", "1", "Completed", T0, T0, None), ("b", "1", "Failed", T0, T0, "e"), ("b", "2", "Failed", T0 + timedelta(1), T0, "e"), ("b", "3", "Failed", T0 + timedelta(2), T0, "e"), ("c", "1", "Failed", T0, T0, "e"), ("d", "1", "Completed", T0, T0 + timedelta(2), None)]
    df = spark.createDataFrame(rows, "dataset_id string, refresh_id string, status string, start_time timestamp, end_time timestamp, error string")
    from pyspark.sql import functions as F

    got = {r.dataset_id: r.reason for r in X.stale_models(df, F.lit(T0 + timedelta(days=2, hours=3))).collect()}
    assert got == {"a": "overdue", "b": "repeated error", "c": "never succeeded"}
    assert {r.id: r.n for r in X.collisions(df.where("refresh_id = '1' and dataset_id in ('a', 'b')")).collect()} == {"a|1": 1, "b|1": 1}
