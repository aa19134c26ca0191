"""What the platform's interfaces answer, as tables: JSON pages are read, fields renamed, times made UTC, durations derived.

The pages come from files (`spark.read.json`), or over a paged client through the Python data source `paged`; no client is
part of this package.
"""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, GreaterThanOrEqual, InputPartition

from vigil.functions.scalars import parse_utc, seconds_between

#: Item types that have job runs; the most refreshes that are asked for; answers that mean that there is nothing.
JOB_CAPABLE = ("DataPipeline", "Notebook", "SparkJobDefinition", "Dataflow", "SemanticModel")
MOST_REFRESHES = 60
JOBS_ABSENT, REFRESHES_ABSENT = (400, 404), (400, 403, 404)

ITEM = "id string, displayName string, type string, workspaceId string"
JOB = "id string, itemId string, jobType string, invokeType string, status string, startTimeUtc string, endTimeUtc string, failureReason string"
MODEL = "id string, name string, configuredBy string, isRefreshable boolean, targetStorageMode string"
REFRESH = "id string, requestId string, refreshType string, status string, startTime string, endTime string, serviceExceptionJson string"


def from_pages(spark: SparkSession, path: str, element: str, key: str = "value") -> DataFrame:
    """The elements under `key` of JSON pages; fields that aren't known are ignored."""
    return spark.read.schema(f"`{key}` array<struct<{element}>>").option("multiLine", True).json(path).select(F.explode(key).alias("x")).select("x.*")


def items(raw: DataFrame, workspaces: DataFrame) -> DataFrame:
    """`items` from raw items and workspaces (id, displayName)."""
    w = workspaces.select(F.col("id").alias("workspace_id"), F.col("displayName").alias("workspace_name"))
    i = raw.select(F.col("workspaceId").alias("workspace_id"), F.col("id").alias("item_id"), F.col("displayName").alias("item_name"), F.col("type").alias("item_type"))
    return i.join(w, "workspace_id", "left").select("workspace_id", "workspace_name", "item_id", "item_name", "item_type")


def since(ts: str, now: Column, days: int) -> Column:
    """Not before so many days ago; an unknown time stays."""
    return F.col(ts).isNull() | (F.col(ts) >= now.cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def job_runs(raw: DataFrame, known: DataFrame, now: Column, since_days: int = 30) -> DataFrame:
    """`job_runs` of the items that can have jobs."""
    r = raw.select(
        F.col("itemId").alias("item_id"), F.col("id").alias("run_id"), F.col("jobType").alias("job_type"), F.col("invokeType").alias("invoke_type"), "status", parse_utc(F.col("startTimeUtc")).alias("start_time"),
        parse_utc(F.col("endTimeUtc")).alias("end_time"), F.col("failureReason").cast("string").alias("failure_reason"),
    )
    capable = known.where(F.col("item_type").isin(*JOB_CAPABLE))
    out = r.where(since("start_time", now, since_days)).join(capable, "item_id").withColumn("duration_seconds", seconds_between(F.col("start_time"), F.col("end_time")))
    return out.select("workspace_id", "workspace_name", "item_id", "item_name", "item_type", "run_id", "job_type", "invoke_type", "status", "start_time", "end_time", "duration_seconds", "failure_reason")


def datasets(raw: DataFrame, workspace_id: Column, workspace_name: Column) -> DataFrame:
    return raw.select(workspace_id.alias("workspace_id"), workspace_name.alias("workspace_name"), F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), F.col("configuredBy").alias("configured_by"), F.col("isRefreshable").alias("is_refreshable"), F.col("targetStorageMode").alias("storage_mode"))


def to_query(models: DataFrame) -> DataFrame:
    """The models whose refreshes are asked for: all but those known not to be refreshable."""
    return models.where(~F.col("is_refreshable").eqNullSafe(F.lit(False)))


def refresh_runs(raw: DataFrame, models: DataFrame, now: Column, since_days: int = 90) -> DataFrame:
    """`refresh_runs` from raw refreshes with dataset_id, of models that are asked for."""
    r = raw.select(
        "dataset_id", F.col("id").alias("refresh_id"), F.col("requestId").alias("request_id"), F.col("refreshType").alias("refresh_type"), "status", parse_utc(F.col("startTime")).alias("start_time"), parse_utc(F.col("endTime")).alias("end_time"),
        F.col("serviceExceptionJson").alias("error"),
    )
    out = r.where(since("start_time", now, since_days)).join(to_query(models).select("workspace_id", "workspace_name", "dataset_id", "dataset_name"), "dataset_id").withColumn("duration_seconds", seconds_between(F.col("start_time"), F.col("end_time")))
    return out.select("workspace_id", "workspace_name", "dataset_id", "dataset_name", "refresh_id", "request_id", "refresh_type", "status", "start_time", "end_time", "duration_seconds", "error")


def run_paths(known: DataFrame) -> DataFrame:
    """item_id, path: where the job runs of each item that can have any are listed."""
    return known.where(F.col("item_type").isin(*JOB_CAPABLE)).select("item_id", F.concat(F.lit("workspaces/"), "workspace_id", F.lit("/items/"), "item_id", F.lit("/jobs/instances")).alias("path"))


def refresh_paths(models: DataFrame) -> DataFrame:
    """dataset_id, path: where the newest refreshes of each model that is asked for are listed."""
    return to_query(models).select("dataset_id", F.concat(F.lit("groups/"), "workspace_id", F.lit("/datasets/"), "dataset_id", F.lit(f"/refreshes?$top={MOST_REFRESHES}")).alias("path"))


def fetched(paths: DataFrame, fetch: Callable[[str, str | None], dict], fields: list[str], absent: tuple[int, ...], key: str = "value", most: int | None = None) -> DataFrame:
    """paths with the fields (text) of the elements that each path lists, `most` of a path at most; a path that answers with a status in `absent` has none. The calls run where the rows are, spread by path."""
    names = paths.columns

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in [*names, *fields]}
            for given in batch.to_pylist():
                for x in itertools.islice(pages(fetch, given["path"], absent, key), most):
                    for n in names:
                        rows[n].append(given[n])
                    for f in fields:
                        rows[f].append(None if x.get(f) is None else x[f] if isinstance(x[f], str) else json.dumps(x[f]))
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.string()) for n, v in rows.items()})

    texts = paths.select(*(F.col(n).cast("string") for n in names))
    return texts.repartition("path").mapInArrow(run, ", ".join(f"`{n}` string" for n in [*names, *fields]))


def scan_job_runs(spark: SparkSession, fetch: Callable[[str, str | None], dict], now: Column, since_days: int = 30) -> DataFrame:
    """`job_runs` of all workspaces: workspaces, the items of each, and the runs of each item that can have any, level by level."""
    root = spark.createDataFrame([("workspaces",)], "path string")
    workspaces = fetched(root, fetch, ["id", "displayName"], ()).select("id", "displayName")
    listed = workspaces.select(F.col("id").alias("workspace_id"), F.concat(F.lit("workspaces/"), "id", F.lit("/items")).alias("path"))
    raw = fetched(listed, fetch, ["id", "displayName", "type"], ()).withColumnRenamed("workspace_id", "workspaceId")
    known = items(raw, workspaces)
    found = fetched(run_paths(known), fetch, ["id", "jobType", "invokeType", "status", "startTimeUtc", "endTimeUtc", "failureReason"], JOBS_ABSENT).withColumnRenamed("item_id", "itemId")
    return job_runs(found, known, now, since_days)


def scan_refresh_runs(spark: SparkSession, fetch: Callable[[str, str | None], dict], now: Column, since_days: int = 90) -> DataFrame:
    """`refresh_runs` of all workspaces: the models of each, and the newest refreshes of each model that is asked for."""
    root = spark.createDataFrame([("groups",)], "path string")
    listed = fetched(root, fetch, ["id", "name"], ()).select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"), F.concat(F.lit("groups/"), "id", F.lit("/datasets")).alias("path"))
    raw = fetched(listed, fetch, ["id", "name", "configuredBy", "isRefreshable", "targetStorageMode"], REFRESHES_ABSENT)
    models = raw.select("workspace_id", "workspace_name", F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), F.col("configuredBy").alias("configured_by"), F.col("isRefreshable").cast("boolean").alias("is_refreshable"), F.col("targetStorageMode").alias("storage_mode"))
    found = fetched(refresh_paths(models), fetch, ["id", "requestId", "refreshType", "status", "startTime", "endTime", "serviceExceptionJson"], REFRESHES_ABSENT, most=MOST_REFRESHES)
    return refresh_runs(found, models, now, since_days)


class Unavailable(Exception):
    """An answer with a status other than success."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def pages(fetch: Callable[[str, str | None], dict], path: str, absent: tuple[int, ...] = (), key: str = "value") -> Iterator[dict]:
    """The elements of all pages of a path: fetch(path, token) answers a page, which names the next token or none. A status in `absent` means that there are none."""
    token = None
    while True:
        try:
            page = fetch(path, token)
        except Unavailable as e:
            if e.status in absent:
                return
            raise
        yield from page.get(key, [])
        token = page.get("continuationToken")
        if not token:
            return


class _Path(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, schema, options, fetch):
        self.fields, self.fetch, self.absent = schema.names, fetch, tuple(int(x) for x in options.get("absent", "").split(",") if x)
        self.paths, self.key = [p for p in options.get("paths", "").split("\n") if p], options.get("key", "value")

    def partitions(self):
        return [_Path(p) for p in self.paths]

    def read(self, partition):
        for x in pages(self.fetch, partition.value, self.absent, self.key):
            yield tuple(None if x.get(f) is None else x[f] if isinstance(x[f], (bool, int, float, str)) else str(x[f]) for f in self.fields)


def paged_source(fetch: Callable[[str, str | None], dict], name: str = "paged") -> type[DataSource]:
    """A data source to register: `spark.dataSource.register(paged_source(fetch))`; options: paths (a line each), key, absent. A path is a partition."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "id string"

        def reader(self, schema):
            return _Reader(schema, self.options, fetch)

    return Paged


class _Range(InputPartition):
    def __init__(self, path: str, since: str, until: str):
        super().__init__(path)
        self.since, self.until = since, until


class _Since:
    """What the batch and the stream reader of a source by time share: a path is a partition, and asks for what began after `since` and not after `until`, page by page."""

    def __init__(self, schema, options, fetch, field):
        self.fields, self.fetch, self.field = schema.names, fetch, field
        self.absent, self.key = tuple(int(x) for x in options.get("absent", "").split(",") if x), options.get("key", "value")
        self.paths, self.since, self.until = [p for p in options.get("paths", "").split("\n") if p], options.get("since", ""), options.get("until", "")

    def read(self, partition):
        if partition.since and partition.since >= partition.until:
            return  # all of it has been fetched: nothing is asked for
        path = f"{partition.value}?since={partition.since}" if partition.since else partition.value
        for x in pages(self.fetch, path, self.absent, self.key):
            at = x.get(self.field) or ""
            if partition.since < at <= partition.until:  # the interface may answer more than it was asked for
                yield tuple(None if x.get(f) is None else x[f] if isinstance(x[f], (bool, int, float, str)) else str(x[f]) for f in self.fields)


class _SinceReader(_Since, DataSourceReader):
    def partitions(self):
        return [_Range(p, self.since, self.until) for p in self.paths]


class _PushedReader(_SinceReader):
    """Takes the least time from filters on the time's column, so that older rows are never asked for."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == (self.field,):
                # from a moment on: all after the largest text below it
                self.since = max(self.since, f.value if isinstance(f, GreaterThan) else f.value[:-1] + chr(ord(f.value[-1]) - 1) + "\uffff")
            yield f  # and Spark applies it as well


class _SinceStream(_Since, DataSourceStreamReader):
    def initialOffset(self):
        return {"until": self.since}

    def latestOffset(self):
        return {"until": self.until}

    def partitions(self, start, end):
        return [_Range(p, start["until"], end["until"]) for p in self.paths]


def since_source(fetch: Callable[[str, str | None], dict], field: str, name: str = "since", pushed: bool = False) -> type[DataSource]:
    """A data source by time, for batches and streams; options: paths (a line each), until (the present, in the interface's own text), since, key, absent.

    As a stream its offset is the time up to which everything was fetched, kept in the checkpoint: the next run asks for what is newer only. What is asked is `path?since=time`. pushed: filters
    on the field reach the calls as well (needs spark.sql.python.filterPushdown.enabled). Times are texts of one form, which compare as they are, after fields that hold none.
    """

    class Since(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"id string, {field} string"

        def reader(self, schema):
            return (_PushedReader if pushed else _SinceReader)(schema, self.options, fetch, field)

        def streamReader(self, schema):
            return _SinceStream(schema, self.options, fetch, field)

    return Since


# ---- what a client needs around its calls ----


def retrying(call: Callable, tries: int = 4, sleep: Callable[[float], None] | None = None) -> Callable:
    """call again when it is told to slow down (Unavailable with status 429): after the seconds it names (`retry_after`), or 1, 2, 4 …; other errors and the last one are raised."""
    wait = sleep or time.sleep

    def again(*args, **kwargs):
        for n in range(tries):
            try:
                return call(*args, **kwargs)
            except Unavailable as e:
                if e.status != 429 or n == tries - 1:
                    raise
                wait(float(getattr(e, "retry_after", None) or 2**n))

    return again


class Tokens:
    """Tokens by scope, fetched anew 300 seconds before they expire. fetch(scope) answers (token, expiry in epoch seconds)."""

    EARLY = 300

    def __init__(self, fetch: Callable[[str], tuple[str, float]], clock: Callable[[], float] = time.time):
        self.fetch, self.clock, self.held = fetch, clock, {}

    def get(self, scope: str) -> str:
        token, until = self.held.get(scope, ("", 0.0))
        if self.clock() >= until - self.EARLY:
            token, until = self.held[scope] = self.fetch(scope)
        return token

    def headers(self, scope: str) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.get(scope)}"}
