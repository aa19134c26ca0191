"""Operators that go beyond the two rules: contributions, rolling baselines, gaps and islands, schema drift, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import micros
from vigil.sources.shared import written


def contributions(current: DataFrame, baseline: DataFrame, dim: str, value: str) -> DataFrame:
    """dim, change, share, mixed: each segment's part of the total change. With changes of both signs shares are of the absolute changes, and say so."""
    a = current.groupBy(dim).agg(F.sum(value).alias("now"))
    b = baseline.groupBy(F.col(dim).alias("__d")).agg(F.sum(value).alias("then"))
    both = a.join(b, F.col(dim).eqNullSafe(F.col("__d")), "full").select(F.coalesce(F.col(dim), F.col("__d")).alias(dim), (F.coalesce("now", F.lit(0.0)) - F.coalesce("then", F.lit(0.0))).alias("change"))
    total = both.agg(F.sum("change").alias("total"), F.sum(F.abs("change")).alias("moved"), F.min("change").alias("lo"), F.max("change").alias("hi"))
    mixed = (F.col("lo") < 0) & (F.col("hi") > 0)
    share = F.when(mixed, F.abs("change") / F.nullif(F.col("moved"), F.lit(0.0))).otherwise(F.col("change") / F.nullif(F.col("total"), F.lit(0.0)))
    return both.crossJoin(F.broadcast(total)).select(dim, "change", share.alias("share"), mixed.alias("mixed"))  # total is one row


def interactions(current: DataFrame, baseline: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """a, b, change, expected: the change of each pair of segments next to what the two would give if they acted apart (the product of their parts of the whole)."""
    both = current.select(a, b, F.col(value).alias("v")).unionByName(baseline.select(a, b, (-F.col(value)).alias("v"))).groupBy(a, b).agg(F.sum("v").alias("change"))
    of_a, of_b, whole = both.groupBy(a).agg(F.sum("change").alias("ca")), both.groupBy(b).agg(F.sum("change").alias("cb")), both.agg(F.sum("change").alias("all"))
    x, y = of_a.withColumnRenamed(a, "__a"), of_b.withColumnRenamed(b, "__b")
    out = both.join(x, F.col(a).eqNullSafe(F.col("__a"))).join(y, F.col(b).eqNullSafe(F.col("__b"))).crossJoin(F.broadcast(whole))  # one row
    return out.select(a, b, "change", (F.col("ca") * F.col("cb") / F.nullif(F.col("all"), F.lit(0.0))).alias("expected"))


def drill_path(current: DataFrame, baseline: DataFrame, dims: list[str], value: str, enough: float = 0.7, allowed: list[str] | None = None) -> DataFrame:
    """level, dimension, segment, change, share, mixed, expected and the dimensions: of each level the segment of the largest share, taken apart further as long as it explains enough. A dimension that isn't allowed is an error.

    Both periods are grouped once, by the grouping sets of the dimensions so far and of the second alone; each group's largest and smallest change then say which
    segment is taken, so the path is a walk over one row a group. expected, at the second level: what the two segments would give if they acted apart; a change far from it is their interaction.
    """
    if allowed is not None and (wrong := [d for d in dims if d not in allowed]):
        raise ValueError(f"not a dimension to take apart by: {', '.join(wrong)}")
    columns = [f"__d{k}" for k in range(len(dims))]
    both = current.select(*(F.col(d).alias(c) for d, c in zip(dims, columns, strict=True)), F.col(value).cast("double").alias("v")).unionByName(baseline.select(*(F.col(d).alias(c) for d, c in zip(dims, columns, strict=True)), (-F.col(value)).cast("double").alias("v")))
    sets = [[F.col(c) for c in columns[: k + 1]] for k in range(len(dims))] + ([[F.col(columns[1])]] if len(dims) > 1 else [])
    cube = written(both.groupingSets(sets, *columns).agg(F.sum("v").alias("change"), F.grouping_id().alias("g")), "drill")
    # the bits of grouping_id are the columns that are left out, the first the highest
    left_out = {k: (1 << (len(dims) - k - 1)) - 1 for k in range(len(dims))}
    change, path, rows = F.col("change"), None, []
    for k, c in enumerate(columns):
        level, parents = cube.where(F.col("g") == left_out[k]), columns[:k]
        group = level.groupBy(*parents).agg(F.sum(change).alias("total"), F.sum(F.abs(change)).alias("moved"), F.min(F.struct(change.alias("change"), F.col(c).alias("d"))).alias("lo"), F.min(F.struct((-change).alias("change"), F.col(c).alias("d"))).alias("hi"))
        lo, hi = F.col("lo")["change"], -F.col("hi")["change"]
        mixed = (lo < 0) & (hi > 0)
        down = F.when(mixed, (-lo > hi) | ((-lo == hi) & (F.col("lo")["d"] < F.col("hi")["d"]))).otherwise(F.col("total") < 0)
        taken = F.when(down, lo).otherwise(hi)
        share = F.when(mixed, F.abs(taken) / F.nullif(F.col("moved"), F.lit(0.0))).otherwise(taken / F.nullif(F.col("total"), F.lit(0.0)))
        top = group.select(*(F.col(x).alias(f"__p{i}") for i, x in enumerate(parents)), F.when(down, F.col("lo")["d"]).otherwise(F.col("hi")["d"]).alias(c), taken.alias("change"), share.alias("share"), mixed.alias("mixed"), F.col("total"))
        if path is None:
            path = top
        else:
            before = path.where(F.col("share") >= enough).select(*parents, F.col("change").alias("before"), F.col("total").alias("all"))
            same = F.lit(True)
            for i, x in enumerate(parents):
                same = same & F.col(f"__p{i}").eqNullSafe(F.col(x))
            path = before.join(top, same).drop(*(f"__p{i}" for i in range(len(parents))))
        path = path.where(F.col("share").isNotNull())
        expected = F.lit(None).cast("double")
        if k == 1:
            alone = cube.where(F.col("g") == sum(1 << (len(dims) - j - 1) for j in range(len(dims)) if j != 1)).select(F.col(c).alias("__alone"), F.col("change").alias("__of_alone"))
            path = path.join(alone, F.col(c).eqNullSafe(F.col("__alone"))).withColumn("expected", F.col("before") * F.col("__of_alone") / F.nullif(F.col("all"), F.lit(0.0)))
            expected = F.col("expected")
        rows.append(path.select(F.lit(k + 1).alias("level"), F.lit(dims[k]).alias("dimension"), F.col(c).cast("string").alias("segment"), "change", "share", "mixed", expected.alias("expected"), *(F.col(x).alias(d) if i <= k else F.lit(None).cast(cube.schema[x].dataType).alias(d) for i, (d, x) in enumerate(zip(dims, columns, strict=True)))))
        path = path.select(*columns[: k + 1], "change", "share", F.col("total") if k == 0 else F.col("all").alias("total"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def drill(current: DataFrame, baseline: DataFrame, dims: list[str], value: str, enough: float = 0.7, allowed: list[str] | None = None) -> list[tuple[str, object, float]]:
    """(dimension, segment, share) of each level of drill_path()."""
    rows = sorted(drill_path(current, baseline, dims, value, enough, allowed).collect(), key=lambda r: r["level"])  # a row a dimension at most
    return [(r["dimension"], r[r["dimension"]], r["share"]) for r in rows]


def rolling_baseline(df: DataFrame, key: str, ts: str, value: str, days: int = 30, scheduled: str | None = None) -> DataFrame:
    """df with mean, spread and n of the key's values in the days before each row, itself and its own moment left out. scheduled: a column; then only rows that it calls Scheduled are looked at and compared with."""
    df = df if scheduled is None else df.where(F.col(scheduled) == "Scheduled")
    span = days * 86_400_000_000
    over = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-span, -1)
    return df.withColumns({"base_mean": F.avg(value).over(over), "base_spread": F.stddev_samp(value).over(over), "base_n": F.count(value).over(over)})


def unusual(df: DataFrame, value: str, sigmas: float = 2.5) -> DataFrame:
    """The rows of rolling_baseline() that lie farther from the mean than so many standard deviations."""
    return df.where(F.abs(F.col(value) - F.col("base_mean")) > sigmas * F.col("base_spread"))


def islands(df: DataFrame, key: list[str], ts: str, gap: str) -> DataFrame:
    """df with island: rows of a key that follow each other within the gap have one number, from 0."""
    order = Window.partitionBy(*key).orderBy(ts)
    new = F.coalesce((F.col(ts) - F.expr(f"INTERVAL {gap}") > F.lag(ts).over(order)).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def island_spans(df: DataFrame, key: list[str], ts: str, gap: str) -> DataFrame:
    """key, island, first, last, n of each island."""
    return islands(df, key, ts, gap).groupBy(*key, "island").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def schema_drift(versions: DataFrame, table: str, version: str, columns: str) -> DataFrame:
    """table, version, added, dropped: columns that a version has and the one before lacks, and the reverse, where there are any."""
    before = F.lag(columns).over(Window.partitionBy(table).orderBy(version))
    out = versions.withColumn("__before", before).where(F.col("__before").isNotNull())
    out = out.select(table, version, F.array_except(columns, "__before").alias("added"), F.array_except("__before", columns).alias("dropped"))
    return out.where((F.size("added") > 0) | (F.size("dropped") > 0))


def bloated(profiles: DataFrame, table: str, version: str, distinct: str, factor: float = 2.0, also: dict[str, float] | None = None) -> DataFrame:
    """The versions whose number of distinct values is a multiple of the one before, and whose further measures (size, refresh time: column to factor) have all grown by theirs."""
    order = Window.partitionBy(table).orderBy(version)
    out = profiles.withColumn("before", F.lag(distinct).over(order)).withColumns({f"__{c}": F.lag(c).over(order) for c in also or {}})
    out = out.where(F.col(distinct) >= factor * F.col("before"))
    for c, f in (also or {}).items():
        out = out.where(F.col(c) >= f * F.col(f"__{c}"))
    return out.drop(*(f"__{c}" for c in also or {}))


def stale_models(refreshes: DataFrame, now: Column, due_hours: float = 24.0, same_error: int = 3) -> DataFrame:
    """dataset_id, last_success, reason of models overdue, never refreshed, or failing with one and the same error time after time."""
    newest = Window.partitionBy("dataset_id").orderBy(F.desc("start_time"), F.desc("refresh_id"))
    numbered = refreshes.withColumn("__n", F.row_number().over(newest))
    recent = F.col("__n") <= same_error
    out = numbered.groupBy("dataset_id").agg(
        F.max(F.when(F.col("status") == "Completed", F.col("end_time"))).alias("last_success"), F.count_if(recent & F.col("error").isNotNull()).alias("__errors"), F.count_distinct(F.when(recent, F.col("error"))).alias("__kinds"),
    )
    hours = (micros(now) - micros("last_success")) / 3.6e9
    reason = F.when((F.col("__errors") == same_error) & (F.col("__kinds") == 1), "repeated error").when(F.col("last_success").isNull(), "never succeeded").when(hours > due_hours, "overdue")
    return out.withColumn("reason", reason).where("reason is not null").select("dataset_id", "last_success", "reason")


def findings(df: DataFrame, category: Column | str, severity: str, name: str, least: int = 2) -> DataFrame:
    """Findings of the performance category, of a severity of at least a warning, but those on automatic date tables."""
    return df.where((F.lower(category) == "performance") & (F.col(severity) >= least) & ~F.coalesce(F.col(name).rlike("(?i)^(LocalDateTable|DateTableTemplate)"), F.lit(False)))


def share_of_parent(df: DataFrame, parent: str, value: str) -> DataFrame:
    """df with share: the value's part of its parent's sum."""
    return df.withColumn("share", F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(parent)), F.lit(0.0)))


def coverage_holes(df: DataFrame, key: str, ts: str, interval_seconds: float, times: float = 2.0) -> DataFrame:
    """key, from, to of the stretches without an observation for longer than a multiple of the interval."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    out = df.select(key, F.col(ts).alias("from"), nxt.alias("to"))
    return out.where((micros("to") - micros("from")) / 1e6 > times * interval_seconds)


def uncounted(versions: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """The versions not yet measured."""
    return versions.join(measured.select(*keys).distinct(), keys, "left_anti")


def saving(df: DataFrame, changes: DataFrame, key: str, ts: str, value: str, changed: str, hours: int = 48) -> DataFrame:
    """key, changed, before, after of each change: the mean value in so many hours on each side of it, the change's moment counted after. Differences of running totals and counts at the
    ends, no pairs; values are summed to nine places. A change without key or time has no means."""
    from vigil.operators.intervals import running_totals

    span = hours * 3_600_000_000
    points = df.where(F.col(value).isNotNull()).select(key, micros(ts).alias("at"), F.lit(1).alias("ord"), F.col(value).alias("total"), F.lit(1).alias("n"))
    known = changes.select(key, changed).distinct()
    edge = lambda at, order, before, after: F.struct((micros(changed) + at).alias("at"), F.lit(order).alias("ord"), F.lit(before).alias("before"), F.lit(after).alias("after"))
    asked = known.select(key, changed, F.explode(F.array(edge(-span, 0, -1, 0), edge(0, 0, 1, -1), edge(span, 2, 0, 1))).alias("e")).select(key, changed, "e.*")
    done = running_totals(points.where(F.col(key).isNotNull()), asked, [key], ["total", "n"], kind="decimal(28,9)")
    mean = lambda side: F.sum(F.col(side) * F.col("total")).cast("double") / F.nullif(F.sum(F.col(side) * F.col("n")).cast("double"), F.lit(0.0))
    return done.groupBy(key, changed).agg(mean("before").alias("before"), mean("after").alias("after"))


def collisions(refreshes: DataFrame, bin_seconds: int = 3600) -> DataFrame:
    """id, n: refreshes of other models that ran at the same time."""
    from vigil.operators.intervals import overlap_counts

    rows = refreshes.select(F.concat_ws("|", "dataset_id", "refresh_id").alias("id"), F.col("dataset_id").alias("item"), F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    return overlap_counts(rows, rows, "id", bin_seconds=bin_seconds)


def contention(refreshes: DataFrame, least: int = 3, slower: float = 1.5) -> DataFrame:
    """dataset_id, refresh_id, n, duration_seconds, median: refreshes that ran beside at least so many of other models and took so much longer than their model's median."""
    usual = refreshes.groupBy("dataset_id").agg(F.median("duration_seconds").alias("median"))
    beside = collisions(refreshes)
    rows = refreshes.withColumn("id", F.concat_ws("|", "dataset_id", "refresh_id")).join(beside, "id").join(usual, "dataset_id")
    return rows.where((F.col("n") >= least) & (F.col("duration_seconds") >= slower * F.col("median"))).select("dataset_id", "refresh_id", "n", "duration_seconds", "median")


def gateway_timeouts(refreshes: DataFrame) -> DataFrame:
    """The refreshes that failed with an error of the gateway about time."""
    error = F.lower(F.coalesce("error", F.lit("")))
    return refreshes.where((F.col("status") == "Failed") & error.contains("gateway") & error.rlike("time ?out|timed out"))


def peaks(df: DataFrame, key: list[str], ts: str, value: str, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """key, start, total, n of the interval of each key in which the value's sum is largest, of equal ones the earliest, of all intervals that slide by so much. Sums are added up by slide before the intervals see them."""
    steps = df.where(F.col(ts).isNotNull()).groupBy(*key, F.window(ts, slide).alias("__s")).agg(F.sum(value).alias("__v"), F.count("*").alias("__n"))
    sums = steps.withColumn("__t", F.col("__s.start")).groupBy(*key, F.window("__t", width, slide).alias("__w")).agg(F.sum("__v").alias("total"), F.sum("__n").alias("n"))
    start = F.col("__w.start")
    return sums.groupBy(*key).agg(F.max_by(F.struct(start.alias("start"), "total", "n"), F.struct("total", -micros(start))).alias("p")).select(*key, "p.*")


def changes_before(activity: DataFrame, incidents: DataFrame, item: str, at: str, when: str) -> DataFrame:
    """incidents with the last activity on their item at or before their time: who did what, and when; null where there is none."""
    from vigil.operators.intervals import as_of

    what = activity.select(item, F.col(at).alias("changed_at"), F.col("user").alias("changed_by"), F.col("operation").alias("change"), "activity_id")
    return as_of(incidents, what.withColumn("__at", F.col("changed_at")), [item], when, "__at", ["changed_at", "changed_by", "change"], arrival=["activity_id"])


def model_growth(stats: DataFrame, factor: float = 2.0) -> DataFrame:
    """The columns of models whose distinct values have grown by a factor from one measurement to the next, and whose bytes have grown with them."""
    rows = stats.select(F.concat_ws("|", "dataset_id", "table_name", "column_name").alias("name"), "dataset_id", "table_name", "column_name", "measured_on", "distinct_values", "size_bytes")
    return bloated(rows, "name", "measured_on", "distinct_values", factor, {"size_bytes": 1.0}).drop("name")


def only_injected(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("origin") == "injected")
