"""Places and quantiles over range partitions, sketches that merge, and the drill from one cube."""

import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigil.operators import extras as X
from vigil.operators import order as O
from vigil.operators import profile as P
from vigil.plans import evidence

T0 = datetime(2026, 1, 1)


def rows(n=500, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "b", None]), rng.choice([None] + [rng.randrange(200) for _ in range(9)]), rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_running(spark, by):
    data = rows()
    df = spark.createDataFrame(data, "id long, k string, v long, w long")
    got = {r.id: (r.before, r.whole) for r in O.running(df, ["v", "id"], by, "w", 5).collect()}
    first = lambda r: (r[2] is not None, r[2] or 0, r[0])
    mine = lambda r: [x for x in data if not by or x[1] == r[1]]
    assert got == {r[0]: (sum(x[3] for x in mine(r) if first(x) < first(r)), sum(x[3] for x in mine(r))) for r in data}
    assert O.running(df.limit(0), ["v"], by).collect() == []


def test_quantiles_against_percentile(spark):
    df = spark.createDataFrame(rows(), "id long, k string, v long, w long")
    got = {r.k: (r.half, r.some, r.top) for r in O.quantiles(df, ["k"], F.col("v"), {"half": 0.5, "some": 0.37, "top": 1.0}).collect()}
    want = {r.k: (r.a, r.b, r.c) for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.37).alias("b"), F.percentile("v", 1.0).alias("c")).collect()}
    assert {k: [round(x, 9) for x in v] for k, v in got.items()} == {k: [round(x, 9) for x in v] for k, v in want.items()}
    assert O.quantiles(df.where("v is null"), ["k"], F.col("v"), {"half": 0.5}).collect() == []


def test_two_groups_are_spread_over_tasks(spark, monkeypatch):
    kept, real = [], O.written
    monkeypatch.setattr(O, "written", lambda df, name: kept.append(real(df, name)) or kept[-1])
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") < n // 2, F.lit(T0)).otherwise(F.lit(T0.replace(year=2027))).alias("ts"), (F.xxhash64("id") % 1_000_000).alias("r"))
    out = {r.period: r.typical for r in P.before_and_after(df, "ts", F.lit(T0.replace(month=6)), "r").collect()}
    assert out == {r.p: r.m for r in df.where("r > 0").groupBy(F.when(F.year("ts") == 2026, "before").otherwise("after").alias("p")).agg(F.median("r").cast("bigint").alias("m")).collect()}
    sizes = [r["count"] for r in kept[0].groupBy("__part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < sum(sizes) * 0.4


def test_every_nth_has_no_window_over_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    out = P.every_nth(df, "x", 6)
    assert [r.x for r in out.collect()] == [0, 166, 332, 498, 664, 830]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    for line in plan.splitlines():
        assert not ("Window [" in line and "], []" in line.replace("[__key", "")), line


def test_quantile_sketches_merge(spark):
    df = spark.range(100_000).select((F.col("id") % 10).alias("day"), (F.xxhash64("id") % 1000).cast("double").alias("v"))
    days = O.quantile_sketches(df, ["day"], F.col("v"))
    got = O.approximate_quantiles(O.merged_quantile_sketches(days.withColumn("all", F.lit(1)), ["all"]), {"half": 0.5, "most": 0.9}).first()
    values = sorted(r.v for r in df.collect())
    for name, f in (("half", 0.5), ("most", 0.9)):
        place = sum(v <= got[name] for v in values) / len(values)
        assert abs(place - f) < 0.02
    assert got["values"] == 100_000


def test_sketches_of_versions(spark, tmp_path):
    """Stored a version and column; what is asked of many versions reads the sketches, and lies within two per cent."""
    df = spark.range(60_000).select((F.col("id") % 6).cast("int").alias("version"), F.lit("t").alias("table"), (F.xxhash64("id") % 25_000).alias("x"), F.when(F.col("id") % 3 > 0, (F.col("id") % 100).cast("double")).alias("y"))
    P.column_sketches(df, ["table", "version"], ["x", "y"]).write.parquet(f"file://{tmp_path}/s")
    stored = spark.read.parquet(f"file://{tmp_path}/s")
    got = {(r.version, r.column): r.distinct_values for r in P.sketched_cardinalities(stored).collect()}
    exact = df.groupBy("version").agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).collect()
    for r in exact:
        for c in ("x", "y"):
            assert abs(got[r.version, c] - r[c]) <= 0.02 * r[c]
    whole = {r.column: (r.distinct_values, r.rows) for r in P.sketched_cardinalities(P.merged_sketches(stored, ["table"])).collect()}
    true = df.agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).first()
    assert all(abs(whole[c][0] - true[c]) <= 0.02 * true[c] and whole[c][1] == 60_000 for c in ("x", "y"))


def test_baselines_by_places(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.choice(["Completed", "Failed", None]), rng.choice([None, float(rng.randrange(50))])) for _ in range(300)] + [("none", "Completed", None)]
    runs = spark.createDataFrame(data, "item_name string, status string, duration_seconds double")
    assert sorted(map(repr, evidence.pipeline_baseline(runs).collect())) == sorted(map(repr, evidence.pipeline_baseline(runs, spread=True).collect()))


def drill_brute(now, then, dims, enough):
    path, out = {}, []
    for d in dims:
        mine = lambda part: [r for r in part if all(r[k] == v for k, v in path.items())]
        change = {}
        for r in mine(now):
            change[r[d]] = change.get(r[d], 0) + r["v"]
        for r in mine(then):
            change[r[d]] = change.get(r[d], 0) - r["v"]
        if not change:
            break
        mixed, total, moved = min(change.values()) < 0 < max(change.values()), sum(change.values()), sum(map(abs, change.values()))
        if not (moved if mixed else total):
            break
        share = {k: abs(v) / moved if mixed else v / total for k, v in change.items()}
        top = min(share, key=lambda k: (-share[k], k is not None, k or ""))
        out.append((d, top, round(share[top], 9)))
        if share[top] < enough:
            break
        path[d] = top
    return out


def test_drill_against_brute_force(spark):
    rng = random.Random(2)
    dims = ["x", "y", "z"]
    for case in range(4):
        make = lambda n, top: [{"x": rng.choice(["p", "q", None]), "y": rng.choice(["a", "b", "c"]), "z": rng.choice(["m", "n"]), "v": float(rng.randrange(top))} for _ in range(n)]
        now, then = make(60, 9), make(40 if case % 2 else 70, 9)
        frame = lambda r: spark.createDataFrame([tuple(x.values()) for x in r], "x string, y string, z string, v double")
        enough = [0.0, 0.2, 0.5, 2.0][case]
        got = [(d, s, round(share, 9)) for d, s, share in X.drill(frame(now), frame(then), dims, "v", enough)]
        assert got == drill_brute(now, then, dims, enough)
    with pytest.raises(ValueError):
        X.drill(frame(now), frame(then), dims, "v", allowed=["x"])
    assert X.drill(frame(now), frame(now), dims, "v") == []


def test_interaction_at_the_second_level(spark):
    """Only the pair (p, a) moves: acting apart, the two would give the same change."""
    then = spark.createDataFrame([("p", "a", 1.0), ("q", "b", 5.0)], "x string, y string, v double")
    now = spark.createDataFrame([("p", "a", 11.0), ("q", "b", 5.0)], "x string, y string, v double")
    first, second = X.drill_path(now, then, ["x", "y"], "v").orderBy("level").collect()
    assert (first.segment, second.segment, second.change, second.expected) == ("p", "a", 10.0, 10.0) and first.expected is None
    assert statistics.mean([first.share, second.share]) == 1.0
