"""Tables written between the steps of one job, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a folder of this machine serves a master in this process (tests); on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "own" not in _local:
        _local["own"] = "file://" + tempfile.mkdtemp(prefix="vigil-steps-")
    return _local["own"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written there and read again: its rows, and what depended on their layout, are fixed, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
