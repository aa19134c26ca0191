"""Joins over time: sums over intervals, the last or next value as of a time, overlapping intervals, points in windows.

Only the list of a window's points (`in_windows`) is pairs. What holds up to a time is a running total: points and questions are put in one order by key and
time, within bins of time, and each bin begins with the totals of the bins before. So the work is linear in both
sides, a hot key is as many tasks as it has bins, and what is in one order is bins, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import micros

#: Width of a bin of time.
BIN_SECONDS = 86_400


def within(events_ts: Column, start: Column, end: Column, before: str = "0 seconds", after: str = "0 seconds") -> Column:
    """start - before <= events_ts <= end + after, both ends in."""
    return (events_ts >= start - F.expr(f"INTERVAL {before}")) & (events_ts <= end + F.expr(f"INTERVAL {after}"))


def running_totals(points: DataFrame, asked: DataFrame, by: list[str], values: list[str], bin_seconds: int = BIN_SECONDS, kind: str = "bigint") -> DataFrame:
    """asked with the total of each value over the points of its `by` before it.

    points: by, at (microseconds), ord, values (of `kind`, whole numbers or decimals, so that sums are exact; null counts as 0). asked: by, at, ord, and anything
    else. A point is before a question if (at, ord) is smaller. Null keys are a key; a null time is before nothing and has nothing before it, and is set aside.
    """
    width = bin_seconds * 1_000_000
    named = [f"__sum_{v}" for v in values]
    row = asked.select(F.struct("*").alias("r")).schema["r"].dataType
    zero = F.lit(0).cast(kind)
    p = points.where(F.col("at").isNotNull()).select(*by, "at", "ord", *(F.coalesce(F.col(v).cast(kind), zero).alias(n) for v, n in zip(values, named, strict=True)), F.lit(None).cast(row).alias("__row"))
    q = asked.where(F.col("at").isNotNull()).select(*by, "at", "ord", *(zero.alias(n) for n in named), F.struct("*").alias("__row"))
    slot = F.floor(F.col("at") / width).alias("__bin")
    whole = p.unionByName(q).withColumn("__bin", slot)
    # a row a key and bin: what all bins before it hold
    bins = whole.groupBy(*by, "__bin").agg(*(F.sum(n).alias(n) for n in named))
    earlier = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(*by, "__bin", *(F.coalesce(F.sum(n).over(earlier), zero).alias(n) for n in named))
    first = carried.select(*by, "__bin", F.lit(None).cast("bigint").alias("at"), F.lit(-1).alias("ord"), *named, F.lit(None).cast(row).alias("__row"))
    within = Window.partitionBy(*by, "__bin").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, 0)  # a bin's first row has no time
    done = whole.unionByName(first).select("__row", *(F.sum(n).over(within).alias(n) for n in named)).where(F.col("__row").isNotNull())
    apart = asked.where(F.col("at").isNull())
    return done.select("__row.*", *(F.col(n).alias(v) for v, n in zip(values, named, strict=True))).unionByName(apart.select("*", *(zero.alias(v) for v in values)))


def interval_totals(points: DataFrame, intervals: DataFrame, by: list[str], ts: str, start: str, end: str, values: list[str], bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """The distinct rows of intervals with the total of each value over the points of the same `by` at start <= ts <= end. An interval with a null key or end has none."""
    p = points.select(*by, micros(ts).alias("at"), F.lit(1).alias("ord"), *values)
    ok = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))
    for k in by:
        p, ok = p.where(F.col(k).isNotNull()), ok & F.col(k).isNotNull()
    rows = intervals.distinct().select(F.struct("*").alias("__i"), *by, F.when(ok, micros(start)).alias("__start"), F.when(ok, micros(end)).alias("__end"))
    ends = F.array(F.struct(F.col("__start").alias("at"), F.lit(0).alias("ord"), F.lit(-1).alias("sign")), F.struct(F.col("__end").alias("at"), F.lit(2).alias("ord"), F.lit(1).alias("sign")))
    asked = rows.select("__i", *by, F.explode(ends).alias("e")).select("__i", *by, "e.*")
    done = running_totals(p, asked, by, values, bin_seconds)
    return done.groupBy("__i").agg(*(F.sum(F.col("sign") * F.col(v)).alias(v) for v in values)).select("__i.*", *values)


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], forward: bool = False, arrival: list[str] | None = None, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """left with the values of the newest right row of the same `by` at or before its time, null where there is none. Null keys are a key; `by` may be empty.

    forward: the first row at or after its time instead. Of equal times the row that arrived first, by the columns `arrival`; without those, and of equal
    arrivals, the smallest values. A null time has no values, and is set aside.
    """
    sign, width = (-1 if forward else 1), bin_seconds * 1_000_000  # looking forward is looking back in time that runs the other way
    at, slot = lambda ts: (sign * micros(ts)).alias("__at"), F.floor(F.col("__at") / width).alias("__bin")
    keep = F.struct(*(F.col(f"`{v}`").alias(v) for v in values))
    one = F.min(F.struct(*(F.col(f"__a{i}") for i in range(len(arrival or []))), "__value"))["__value"].alias("__value")
    known = right.where(F.col(right_ts).isNotNull()).select(*by, at(right_ts), keep.alias("__value"), *(F.col(c).alias(f"__a{i}") for i, c in enumerate(arrival or []))).groupBy(*by, "__at").agg(one)
    known = known.select("*", slot)
    kind = known.schema["__value"].dataType
    rows = left.select(*by, at(left_ts), F.struct("*").alias("__row"))
    a = rows.where("__at is not null").select(*by, "__at", slot, F.lit(2).alias("__side"), F.lit(None).cast(kind).alias("__value"), "__row")
    none = F.lit(None).cast(a.schema["__row"].dataType).alias("__row")
    b = known.select(*by, "__at", "__bin", F.lit(1).alias("__side"), "__value", none)
    # a row a key and bin: the last value before the bin
    bins = known.groupBy(*by, "__bin").agg(F.max_by("__value", "__at").alias("__last")).unionByName(a.select(*by, "__bin").distinct(), allowMissingColumns=True).groupBy(*by, "__bin").agg(F.first("__last", ignorenulls=True).alias("__last"))
    before = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    seeds = bins.select(*by, F.lit(None).cast("bigint").alias("__at"), "__bin", F.lit(0).alias("__side"), F.last("__last", ignorenulls=True).over(before).alias("__value"), none)
    over = Window.partitionBy(*by, "__bin").orderBy(F.asc_nulls_first("__at"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).unionByName(seeds).withColumn("__seen", F.last("__value", ignorenulls=True).over(over)).where("__side = 2").select("__row", "__seen")
    seen = seen.unionByName(rows.where("__at is null").select("__row", F.lit(None).cast(kind).alias("__seen")))
    return seen.select("__row.*", *(F.col("__seen")[v].alias(f"as_of_{v}" if v in left.columns else v) for v in values))


def overlap_counts(intervals: DataFrame, others: DataFrame, id_col: str, start: str = "start", end: str = "end", item: str = "item", bin_seconds: int = 3600) -> DataFrame:
    """id, n: how many of the other intervals, of another item, share a moment with each; ends count as shared, a null item is another item.

    Those that share a moment are those that begin by the end, less those that end before the start; and the same of the own item, which are taken off.
    """
    ok = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))
    asked = intervals.where(ok).select(F.col(id_col).alias("id"), F.col(item).alias("i"), F.explode(F.array(F.struct(micros(start).alias("at"), F.lit("ended").alias("what")), F.struct(micros(end).alias("at"), F.lit("begun").alias("what")))).alias("e"))
    asked = asked.select("id", "i", "e.*", F.lit(1).alias("ord"))
    # of equal times: beginnings count for an end, ends don't count for a beginning
    points = others.where(ok).select(F.col(item).alias("i"), F.explode(F.array(F.struct(micros(start).alias("at"), F.lit(0).alias("ord"), F.lit(1).alias("begun"), F.lit(0).alias("ended")), F.struct(micros(end).alias("at"), F.lit(2).alias("ord"), F.lit(0).alias("begun"), F.lit(1).alias("ended")))).alias("e"))
    points = points.select("i", "e.*")
    gained = lambda by: running_totals(points, asked, by, ["begun", "ended"], bin_seconds).select("id", F.when(F.col("what") == "begun", F.col("begun")).otherwise(-F.col("ended")).alias("c"))
    found = gained([]).union(gained(["i"]).select("id", -F.col("c"))).groupBy("id").agg(F.sum("c").alias("n"))
    return intervals.select(F.col(id_col).alias("id")).join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def swept(points: DataFrame, windows: DataFrame, by: str, ts: str, start: str, end: Column, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """What points and windows of one key make of each other, without pairs: one row a point and two rows a window, from one pass over both.

    side, point, window (the rows), open, seen, next. side 0, a point: `open` windows hold it. Side 1, a window's start, and side 2, its end: `seen` points lie before the one and by the other,
    so the difference is how many it holds; `next` (at side 1) is the time of the first point at or after the start. A point without key or time is in no window; a window without a key or
    start, or that ends before it starts, holds none: both are rows with nulls. A window's start is a step up under running totals and its end a step down, both ends in.
    """
    width = bin_seconds * 1_000_000
    p = points.select(F.col(by).alias("__by"), micros(ts).alias("at"), F.lit(0).alias("side"), F.struct("*").alias("point"))
    w = windows.select(F.col(by).alias("__by"), micros(start).alias("a"), micros(end).alias("b"), F.struct("*").alias("window"))
    w = w.withColumn("__by", F.when(F.col("a") <= F.col("b"), F.col("__by")))
    edges = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("side")), F.struct(F.col("b").alias("at"), F.lit(2).alias("side")))
    rows = p.unionByName(w.select("__by", F.explode(edges).alias("e"), "window").select("__by", "e.*", "window"), allowMissingColumns=True)
    apart = F.col("__by").isNull() | F.col("at").isNull()
    # Of equal times: starts, then points, then ends. Keys that can't be null and a row in one array keep filters and column pruning above the exchange, so that both uses below read the same one
    event = F.struct("at", "side", F.element_at(F.array(F.lit(1), F.lit(0), F.lit(2)), F.col("side") + 1).alias("ord"), "point", "window")
    key = F.struct(F.when(~apart, F.col("__by")).alias("k"), F.when(apart, F.xxhash64(F.to_json(event))).alias("deal"))
    held = rows.select(key.alias("__by"), F.coalesce(F.when(~apart, F.floor(F.col("at") / width)), F.lit(0)).alias("__bin"), F.array(event).alias("__e")).repartition("__by", "__bin")
    e = F.element_at("__e", 1)
    one = lambda side: F.when(e["side"] == side, 1).otherwise(0)
    bins = held.groupBy("__by", "__bin").agg(F.sum(one(1) - one(2)).alias("open"), F.sum(one(0)).alias("seen"), F.min(F.when(e["side"] == 0, e["at"])).alias("next"))
    order = Window.partitionBy("__by").orderBy("__bin")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carried = bins.select(F.col("__by").alias("__k"), F.col("__bin").alias("__b"), F.coalesce(F.sum("open").over(earlier), F.lit(0)).alias("c_open"), F.coalesce(F.sum("seen").over(earlier), F.lit(0)).alias("c_seen"), F.min("next").over(later).alias("c_next"))
    inside = Window.partitionBy("__by", "__bin").orderBy(e["at"], e["ord"])
    sums, rest = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    totals = held.select("__by", "__bin", "__e", F.sum(one(1) - one(2)).over(sums).alias("open"), F.sum(one(0)).over(sums).alias("seen"), F.min(F.when(e["side"] == 0, e["at"])).over(rest).alias("next"))
    done = totals.join(carried, (F.col("__by") == F.col("__k")) & (F.col("__bin") == F.col("__b")), "left")
    known = F.col("__by")["deal"].isNull()
    return done.select(
        e["side"].alias("side"), e["point"].alias("point"), e["window"].alias("window"), F.when(known, F.col("open") + F.col("c_open")).otherwise(0).alias("open"), F.when(known, F.col("seen") + F.col("c_seen")).otherwise(0).alias("seen"),
        F.timestamp_micros(F.when(known & (e["side"] == 1), F.coalesce("next", "c_next"))).alias("next"),
    )


def in_windows(points: DataFrame, windows: DataFrame, item: str, ts: str, start: str, end: str, now: Column) -> DataFrame:
    """The pairs of a window and a point of its item at start <= ts <= end; a window without end is open until now."""
    w, p = windows.alias("w"), points.alias("p")
    return w.join(p, (F.col(f"w.{item}") == F.col(f"p.{item}")) & within(F.col(f"p.{ts}"), F.col(f"w.{start}"), F.coalesce(F.col(f"w.{end}"), now)))


def split_by(rows: DataFrame, claimed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is claimed, the others)."""
    ids = claimed.select(key).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")
