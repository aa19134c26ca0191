"""Latest known values: repeated observations of a key become one row that holds, column by column, the newest value that was known.

A null never erases a value. Of equal times of collection the later arrival counts (`ingest_batch`, then `ingest_seq`).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalars import as_utc
from vigil.sources.schemas import NATURAL_KEYS

#: How long a commit may go unseen after it was made.
SETTLING = timedelta(minutes=10)


def _order(df: DataFrame) -> list[str]:
    return [c for c in ("collected_at", "ingest_batch", "ingest_seq") if c in df.columns]


def latest_known(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key. One aggregation, combined before the shuffle: each column is the value of the largest order among its known ones. Null keys are a key."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)} to tell rows apart by")
    values = [c for c in df.columns if c not in keys]
    if not values:
        return df.select(*keys).dropDuplicates()
    if "collected_at" not in df.columns:
        return newest_row(df, keys)
    order = F.struct(*_order(df))
    known = [F.max(F.when(F.col(f"`{c}`").isNotNull(), F.struct(order.alias("o"), F.col(f"`{c}`").alias("v"))))["v"].alias(c) if _orderable(df, c) else F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), order)).alias(c) for c in values]
    return df.groupBy(*keys).agg(*known).select(*df.columns)


def _orderable(df: DataFrame, column: str) -> bool:
    return not df.schema[column].dataType.simpleString().startswith(("map", "variant"))


def newest_row(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key in order of arrival, for observations without a time of collection; without columns of arrival there is no such order, which is an error. One aggregation, combined before its shuffle;
    of rows that arrived alike the largest by its columns, where those can be compared."""
    arrival = [c for c in ("ingest_batch", "ingest_seq") if c in df.columns]
    if not arrival:
        raise ValueError("no collected_at, ingest_batch or ingest_seq to tell which row came last")
    plain = [c for c in df.columns if _orderable(df, c) and c not in arrival]
    order = F.struct(*arrival, *(F.col(f"`{c}`") for c in plain))
    return df.groupBy(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), order).alias("__row")).select("__row.*")


def view(df: DataFrame, dataset: str) -> DataFrame:
    """A dataset as rules see it: UTC times, latest known values by its natural key; as stored without one."""
    df = as_utc(df)
    return latest_known(df, NATURAL_KEYS[dataset]) if dataset in NATURAL_KEYS else df


def load(store, dataset: str) -> DataFrame:
    return view(store.read(dataset), dataset)


def complete_until(commits: DataFrame, now: datetime) -> DataFrame:
    """One row, `cutoff`: runs that end at or after it can't be judged yet. Ten minutes before the newest collection of commits; before now if there is none."""
    newest = F.max("collected_at") if "collected_at" in commits.columns else F.lit(None).cast("timestamp")
    return commits.agg((F.coalesce(newest, F.lit(now).cast("timestamp")) - F.expr(f"INTERVAL {int(SETTLING.total_seconds())} SECONDS")).alias("cutoff"))


def last_collected(store, datasets: list[str] | None = None) -> DataFrame:
    """dataset, seen: the newest time of collection in the raw rows of each dataset; null for one never collected."""
    out = None
    for name in datasets or sorted(NATURAL_KEYS):
        part = store.read(name).agg(F.max("collected_at").cast("timestamp").alias("seen")).select(F.lit(name).alias("dataset"), "seen")
        out = part if out is None else out.union(part)
    return out


def stored_and_distinct(raw: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """stored, distinct: rows as appended and facts that they are about, told apart by the keys or by all columns."""
    return raw.agg(F.count(F.lit(1)).alias("stored"), F.count_distinct(F.struct(*(keys or raw.columns))).alias("distinct"))


def counts(store, datasets: list[str] | None = None) -> DataFrame:
    """dataset, stored, distinct of each dataset."""
    out = None
    for name in datasets or sorted(NATURAL_KEYS):
        part = stored_and_distinct(store.read(name), NATURAL_KEYS.get(name)).select(F.lit(name).alias("dataset"), "stored", "distinct")
        out = part if out is None else out.union(part)
    return out
