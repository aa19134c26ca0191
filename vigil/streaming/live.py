"""The same semantics on streams. The reference point for lateness is the watermark: collection may lag by ten minutes, and what could still change is not judged.

These go beyond batch detection; their final output over a finite stream is that of the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from vigil.functions.scalars import micros
from vigil.plans.silent_delivery import SKEW

LAG = "10 minutes"


def follow(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    """Files that arrive under a path, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def distinct_facts(observations: DataFrame, keys: list[str], ts: str, lag: str = LAG) -> DataFrame:
    """Each fact once, however often it is observed within the watermark."""
    return observations.withWatermark(ts, lag).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, key: str, ts: str, width: str, slide: str | None = None, lag: str = LAG) -> DataFrame:
    """key, start, end, n of tumbling or sliding windows that are complete."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, lag).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str, lag: str = LAG) -> DataFrame:
    """key, start, end, n of runs of events that follow each other within the gap."""
    return events.withWatermark(ts, lag).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deliveries(runs: DataFrame, commits: DataFrame, expected: DataFrame, longest: str = "12 hours", skew: str = SKEW, lag: str = LAG) -> DataFrame:
    """Runs with the commits of their interval, joined as streams: a run without any comes out, with nulls, once the watermark is past its interval."""
    r = runs.join(F.broadcast(expected), F.col("item_name") == F.col("pipeline")).select("run_id", F.col("table").alias("expected_table"), "minimum_rows", "start_time", "end_time").withWatermark("end_time", lag)
    c = commits.select("table_name", F.col("timestamp").alias("committed_at"), "rows_added").withWatermark("committed_at", lag)
    near = (
        (F.col("table_name") == F.col("expected_table")) & (F.col("committed_at") >= F.col("start_time") - F.expr(f"INTERVAL {skew}")) & (F.col("committed_at") <= F.col("end_time") + F.expr(f"INTERVAL {skew}"))
        & (F.col("committed_at") >= F.col("end_time") - F.expr(f"INTERVAL {longest}") - F.expr(f"INTERVAL {skew}"))
    )
    return r.join(c, near, "leftOuter")


def silent(delivered: DataFrame) -> DataFrame:
    """From the finished deliveries(): the runs that delivered too little; an unknown count is no finding."""
    keys = ["run_id", "expected_table", "minimum_rows"]
    out = delivered.groupBy(*keys).agg(F.count_if(F.col("table_name").isNotNull() & F.col("rows_added").isNull()).alias("unknown"), F.coalesce(F.sum("rows_added"), F.lit(0)).alias("rows_delivered"))
    return out.where((F.col("unknown") == 0) & (F.col("rows_delivered") < F.col("minimum_rows"))).drop("unknown")


class _Known(StatefulProcessor):
    """A key's newest known values: of each column the value and when it was collected. Rows may come in any order and again; a timer at the newest time of collection lets the key out once the watermark is past it."""

    def __init__(self, keys: list[str], values: list[str], state: T.StructType, order: list[str]):
        self.names, self.values, self.state, self.order = [*keys, *values, "__at"], values, state, order

    def init(self, handle) -> None:
        self.handle, self.known = handle, handle.getValueState("known", self.state)

    def handleInputRows(self, key, rows, timerValues):
        held = self.known.get()
        held = list(held) if held is not None else [None] * len(self.state)
        for r in rows:
            if r["__at"] is None:
                continue
            at = [r["__at"]] + [-1 if r[c] is None else int(r[c]) for c in self.order]
            for i, c in enumerate(self.values):
                mine = held[i * 4 + 1 : i * 4 + 4]
                if r[c] is not None and (mine[0] is None or at + [-1] * (3 - len(at)) >= mine):
                    held[i * 4 : i * 4 + 4] = [r[c], *at, *[-1] * (3 - len(at))]
            if held[-1] is None or at[0] > held[-1]:
                held[-1] = at[0]
        if held[-1] is not None:
            self.known.update(tuple(held))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(held[-1] // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.known.get()
        yield Row(*self.names)(*key, *(held[i * 4] for i in range(len(self.values))), held[-1])

    def close(self) -> None:
        pass


def latest_known(observations: DataFrame, keys: list[str], ts: str = "collected_at", lag: str = LAG) -> DataFrame:
    """A stream's latest known values: the keys, each column's newest known value, and the newest time of collection, a row whenever the watermark passes what a key has. A key's last row is that of the batch operator,
    whatever the order in which its rows came and however often. Columns `ingest_batch` and `ingest_seq` tell rows of equal time apart. State is kept in RocksDB, a value a key: nothing is dropped, as any value may still be the newest known one."""
    order = [c for c in ("ingest_batch", "ingest_seq") if c in observations.columns]
    values = [c for c in observations.columns if c not in [*keys, ts, *order]]
    kind = {f.name: f.dataType for f in observations.schema}
    state, out = [], [T.StructField(k, kind[k]) for k in keys]
    for i, c in enumerate(values):
        state += [T.StructField(f"v{i}", kind[c]), *(T.StructField(f"{p}{i}", T.LongType()) for p in "abc")]
        out.append(T.StructField(c, kind[c]))
    state.append(T.StructField("newest", T.LongType()))
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    grouped = observations.withWatermark(ts, lag).withColumn("__at", micros(ts)).groupBy(*keys)
    done = grouped.transformWithState(_Known(keys, values, T.StructType(state), order), T.StructType([*out, T.StructField("__at", T.LongType())]), "Update", "EventTime")
    return done.select(*keys, *values, F.timestamp_micros("__at").alias(ts))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs over all that is there and stops; what was done is kept in the checkpoint folder."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


