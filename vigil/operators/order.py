"""Places in an order, and quantiles, without a task that holds all rows or all values of a key.

Rows are dealt into range partitions, so that what comes before a row is the partitions before its own and the rows before it there. The first is
a running total over one row a partition and key, the second a window within a partition. Equal rows of the order share a partition: where many
tie, count them first, as `quantiles` does, or give the order further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.sources.shared import written


def running(df: DataFrame, order: list[str], by: list[str] | None = None, weight: str | None = None, parts: int | None = None) -> DataFrame:
    """df with before, the sum of the weight (or the number) of the rows of its key that come before it in the order, and whole, that of all rows of the key. Nulls come first and are a key; ties are in no
    particular order. The partitions are written first, so that all that follows sees the same."""
    by = by or []
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*by) if by else F.lit(0)
    one = F.coalesce(F.col(weight), F.lit(0)).cast("bigint") if weight else F.lit(1).cast("bigint")
    dealt = written(df.repartitionByRange(parts, *by, *order).withColumns({"__part": F.spark_partition_id(), "__key": key, "__one": one}), "order")
    sums = dealt.groupBy("__part", "__key").agg(F.sum("__one").alias("__sum"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # rows: partitions that have the key
    offsets = sums.select(F.col("__part").alias("__p"), F.col("__key").alias("__k"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"), F.sum("__sum").over(Window.partitionBy("__key")).alias("whole"))
    inside = Window.partitionBy("__part", "__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("__inside", F.coalesce(F.sum("__one").over(inside), F.lit(0)))
    out = rows.join(offsets, (F.col("__part") == F.col("__p")) & (F.col("__key") == F.col("__k")))
    return out.withColumn("before", F.col("__offset") + F.col("__inside")).select(*df.columns, "before", "whole")


def every_nth(df: DataFrame, order: str, take: int = 6) -> DataFrame:
    """Rows spread evenly over an order: each max(1, n // take)-th, `take` at most."""
    step = F.greatest(F.lit(1), F.floor(F.col("whole") / take))
    return running(df, [order]).where((F.col("before") % step == 0) & (F.col("before") < step * take)).orderBy("before").drop("before", "whole")


def quantiles(df: DataFrame, by: list[str], value: Column, fractions: dict[str, float]) -> DataFrame:
    """by and a column of each named fraction: the exact quantiles of each key's known values, as percentile() has them (between two values by their distance). A key without known values has no row.

    Values are counted first, so that what is put in order is distinct values, and those are spread over all tasks, however few keys there are.
    """
    counted = df.select(*by, value.cast("double").alias("__v")).where("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    placed = running(counted, ["__v"], by, "__n")
    aggregates, near = {}, F.lit(False)
    for name, f in fractions.items():
        at = F.lit(f) * (F.col("whole") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("before") <= place) & (place < F.col("before") + F.col("__n"))
            near = near | here
            aggregates[f"__{side}_{name}"] = F.max(F.when(here, F.col("__v")))
    found = placed.where(near).groupBy(*by).agg(F.max("whole").alias("whole"), *(a.alias(k) for k, a in aggregates.items()))
    out = []
    for name, f in fractions.items():
        at, lo, hi = F.lit(f) * (F.col("whole") - 1), F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
    return found.select(*by, *out)


def quantile_sketches(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, values (how many are known), sketch: of each key a sketch of bounded size, from which quantiles can be had approximately, and which merges with others."""
    return df.select(*by, value.cast("double").alias("__v")).where("__v is not null").groupBy(*by).agg(F.count("*").alias("values"), F.kll_sketch_agg_double("__v").alias("sketch"))


def merged_quantile_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of fewer keys, made of those of more, without their rows."""
    return sketches.groupBy(*by).agg(F.sum("values").alias("values"), F.kll_merge_agg_double("sketch").alias("sketch"))


def approximate_quantiles(sketches: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """The sketches with a column of each named fraction: a value whose place is within about 1.7 % of all from the place asked for."""
    return sketches.select(*(c for c in sketches.columns if c != "sketch"), *(F.kll_sketch_get_quantile_double("sketch", F.lit(f)).alias(name) for name, f in fractions.items()))
