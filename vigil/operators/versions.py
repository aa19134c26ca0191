"""What each version of a table added: the difference of counts to the version before that is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rows_added(versions: DataFrame, max_counted: int | None = None, table: str = "table_name", version: str = "version", n: str = "n") -> DataFrame:
    """versions with rows_added: of version 0 its own count, of others the count less that of the version before that is kept.

    Null, which is not zero, where either count is unknown, where the first version kept isn't version 0, and beyond the
    newest max_counted versions. It may be negative.
    """
    order = Window.partitionBy(table).orderBy(version)
    before = F.lag(F.col(n)).over(order)
    added = F.when(F.col(version) == 0, F.col(n)).otherwise(F.col(n) - before)
    out = versions.withColumn("rows_added", added.cast("bigint"))
    if max_counted is not None:
        newest = F.row_number().over(Window.partitionBy(table).orderBy(F.desc(version)))
        out = out.withColumn("__age", newest).withColumn("rows_added", F.when(F.col("__age") <= F.when(F.col(version) == 0, max_counted + 1).otherwise(max_counted), F.col("rows_added"))).drop("__age")
    return out
