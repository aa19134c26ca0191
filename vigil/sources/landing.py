"""Samples of the files that pipelines read, and batches written for them. A file that is missing is a row like others."""

from __future__ import annotations

import re
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.scalars import parse_utc

#: Larger files are not counted: their rows are unknown.
COUNT_LIMIT = 500 * 1024 * 1024
SAMPLE = "source_name string, path string, exists boolean, size_bytes bigint, modified_ms bigint"


def _statuses(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, int, int]]:
    """path to (address, bytes, time of change in ms) of each file that is there, by the listings of their folders, each once. One whose folder isn't there or can't be listed counts as missing."""
    folders: dict[str, dict[str, list[str]]] = {}
    at = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    for path in paths:
        p = at(path.rstrip("/"))
        if p.getParent() is not None:
            folders.setdefault(p.getParent().toString(), {}).setdefault(p.getName(), []).append(path)
    out = {}
    for folder, names in folders.items():
        try:
            found = at(folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at(folder))
        except Exception:  # noqa: BLE001  a folder that can't be listed: its files count as missing
            continue
        for s in found:
            for path in names.get(s.getPath().getName(), []):
                out[path] = s.getPath().toString(), s.getLen(), s.getModificationTime()
    return out


def _counts(spark: SparkSession, addresses: list[str]) -> dict[str, int | None]:
    """Rows below the header of each file, by one scan of all; None, not zero, for one that can't be read. A scan that fails is done again by halves, so that a bad file costs a few jobs and takes no other with it."""
    if not addresses:
        return {}
    name, folder = F.col("_metadata.file_path"), F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    try:
        rows = spark.read.option("header", True).schema("__first string").csv(addresses).groupBy(name.alias("f"), folder.alias("d")).agg(F.count("*").alias("n")).collect()  # a row a file that has rows
    except Exception:  # noqa: BLE001  unreadable is unknown
        if len(addresses) == 1:
            return {addresses[0]: None}
        half = len(addresses) // 2
        return _counts(spark, addresses[:half]) | _counts(spark, addresses[half:])
    out = dict.fromkeys(addresses, 0)
    plain = {_plain(a): a for a in addresses}
    for r in rows:
        a = plain.get(_plain(unquote(r["f"]))) or plain.get(_plain(unquote(r["d"])))  # a source may be a folder of files
        out[a] += r["n"]
    return out


def _plain(address: str) -> str:
    """One spelling of an address: with one slash after the scheme."""
    return re.sub("^([a-z0-9+.-]+:)/+", r"\1/", address)


def collect(spark: SparkSession, sources: dict[str, str], collected_at: datetime, workspace: str = "") -> DataFrame:
    """A row of `landing_files` a source (name to path), all of one time of collection. Folders are listed once each, and all files that are there and not too large are counted by one scan."""
    found = _statuses(spark, list(dict.fromkeys(sources.values())))
    counted = _counts(spark, sorted({f[0] for f in found.values() if f[1] <= COUNT_LIMIT}))
    rows = []
    for name, path in sources.items():
        address, size, changed = found.get(path, (None, None, None))
        rows.append((workspace, name, path, address is not None, size, changed, counted.get(address)))
    df = spark.createDataFrame(rows, "workspace_name string, source_name string, path string, exists boolean, size_bytes bigint, modified_ms bigint, data_rows bigint")
    return df.select("workspace_name", "source_name", "path", "exists", "size_bytes", F.timestamp_millis("modified_ms").alias("modified_at"), "data_rows", F.lit(collected_at).cast("timestamp").alias("collected_at"))


def write_batch(df: DataFrame, path: str, rename: dict[str, str] | None = None) -> str:
    """One CSV file with a header; columns may be renamed, which is how a drifted source looks. It is written aside and takes the path's place when it is whole."""
    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    aside, fs = path.rstrip("/") + ".writing", at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    df.withColumnsRenamed(rename or {}).coalesce(1).write.mode("overwrite").option("header", True).csv(aside)
    [made] = [x.getPath() for x in fs.listStatus(at(aside)) if x.getPath().getName().startswith("part-")] or [None]
    if made is None:  # no partition at all: the header alone
        spark.createDataFrame([(",".join((rename or {}).get(c, c) for c in df.columns),)], "line string").coalesce(1).write.mode("overwrite").text(aside)
        [made] = [x.getPath() for x in fs.listStatus(at(aside)) if x.getPath().getName().startswith("part-")]
    fs.delete(at(path), True)
    if not fs.rename(made, at(path)):
        raise OSError(f"{path} can't be written")
    fs.delete(at(aside), True)
    return path


def read_csv(spark: SparkSession, path: str, dates: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; the columns in `dates` as timestamps in UTC, null where they are none."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.withColumns({c: parse_utc(F.col(c)) for c in dates or [] if c in rows.columns})
