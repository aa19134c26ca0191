from datetime import datetime, timedelta

from vigil.plans import silent_delivery as S
from vigil.streaming import live

T0 = datetime(2026, 1, 1)
EVENTS = "k string, t timestamp, n int"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_streams_end_as_batches(spark, tmp_path):
    src, m = f"file://{tmp_path}/in", lambda k: timedelta(minutes=k)
    rows = [("a", T0, 1), ("a", T0 + m(3), 2), ("a", T0 + m(3), 2), ("a", T0 + m(40), 3), ("b", T0 + m(5), 4)]
    put(spark, src, rows, EVENTS)
    put(spark, src, [("z", T0 + m(600), 0)], EVENTS)
    stream = live.follow(spark, src, EVENTS)
    for name, df, want in (
        ("w", live.windowed_counts(stream, "k", "t", "10 minutes"), {("a", T0, 3), ("a", T0 + m(40), 1), ("b", T0, 1)}),
        ("s", live.sessions(stream, "k", "t", "10 minutes"), {("a", T0, 3), ("a", T0 + m(40), 1), ("b", T0 + m(5), 1)}),
    ):
        live.run_once(df, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}.c")
        put_again = spark.read.parquet(f"file://{tmp_path}/{name}").collect()
        assert {(r.k, r.start, r.n) for r in put_again} == want
    live.run_once(live.distinct_facts(stream, ["k", "n"], "t"), f"file://{tmp_path}/d", f"file://{tmp_path}/d.c")
    assert spark.read.parquet(f"file://{tmp_path}/d").count() == 5


def test_deliveries(spark, tmp_path):
    runs, commits = f"file://{tmp_path}/runs", f"file://{tmp_path}/commits"
    s = timedelta(seconds=1)
    R, C = "item_name string, run_id string, start_time timestamp, end_time timestamp", "table_name string, timestamp timestamp, rows_added bigint"
    put(spark, runs, [("load", f"r{i}", T0 + i * 3600 * s, T0 + (i * 3600 + 20) * s) for i in range(4)] + [("load", "last", T0 + timedelta(days=3), T0 + timedelta(days=3))], R)
    put(spark, commits, [("t", T0 + 15 * s, 0), ("t", T0 + 3700 * s, 5), ("t", T0 + 7210 * s, None), ("t", T0 + timedelta(days=3), 1)], C)
    expected = S.expectations(spark, [S.WriteExpectation("load", "t", "w")])
    df = live.deliveries(live.follow(spark, runs, R), live.follow(spark, commits, C), expected)
    live.run_once(df, f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    live.run_once(df, f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    got = live.silent(spark.read.parquet(f"file://{tmp_path}/out"))
    assert {r.run_id for r in got.collect()} == {"r0", "r3"}


def test_latest_known_as_a_stream(spark, tmp_path):
    """In any order of arrival, and replayed, a key's last row is that of the batch operator."""
    import random

    from pyspark.sql import functions as F

    from vigil.operators.latest import latest_known

    schema = "k string, a string, b long, collected_at timestamp, ingest_seq long"
    rng = random.Random(6)
    rows = [(rng.choice("pqr"), rng.choice([None, "x", "y", "z"]), rng.choice([None, *range(9)]), T0 + timedelta(minutes=rng.randrange(8)), i) for i in range(60)]
    batch = {r.k: (r.a, r.b, r.collected_at) for r in latest_known(spark.createDataFrame(rows, schema), ["k"]).collect()}
    for n in range(2):
        src = f"file://{tmp_path}/in{n}"
        rng.shuffle(rows)
        for part in (rows[:20], rows[20:40], rows[40:] + rows[:15]):
            put(spark, src, part, schema)
        put(spark, src, [("end", None, None, T0 + timedelta(days=1), 99)], schema)
        stream = live.latest_known(live.follow(spark, src, schema, 1), ["k"])
        query = stream.writeStream.format("memory").queryName(f"known{n}").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c{n}").trigger(availableNow=True).start()
        query.awaitTermination()
        out = spark.table(f"known{n}").where("k <> 'end'")
        last = out.groupBy("k").agg(F.max("collected_at").alias("collected_at"), F.count("*").alias("n")).collect()
        got = {r.k: (r.a, r.b, r.collected_at) for r in out.collect()}
        assert got == batch and {r.k for r in last} == set(batch)
