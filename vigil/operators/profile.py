"""Counts and profiles of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.order import every_nth, quantiles  # noqa: F401  every_nth is part of the profile


def cardinalities(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """column, distinct_values, share of rows of each column, in one pass, largest first. approximate: with a bounded sketch a column instead of a shuffle of its values."""
    columns = columns or df.columns
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(F.count(F.lit(1)).alias("__n"), *(count(F.col(f"`{c}`")).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("distinct_values")) for c in columns))
    out = row.select("__n", F.explode(pairs).alias("p")).select("p.*", (F.col("p.distinct_values") / F.nullif(F.col("__n"), F.lit(0))).alias("share"))
    return out.orderBy(F.desc("distinct_values"), "column")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n of each value, null too, most frequent first."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def prefixed_counts(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """metric, value: the rows of each value but null."""
    known = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").cast("double").alias("value"))
    return known.select(F.concat(F.lit(prefix + "_"), F.col(column).cast("string")).alias("metric"), "value")


def daily(df: DataFrame, ts: str) -> DataFrame:
    """day, n, first, last of each day."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def before_and_after(df: DataFrame, ts: str, boundary: Column, rows_added: str) -> DataFrame:
    """period, judged, delivered, none, unknown, typical: the rows on each side of a boundary; the typical delivery is the median's whole part. Two groups, and neither's values are in one task."""
    rows = df.select(F.when(F.col(ts) < boundary, "before").otherwise("after").alias("period"), F.col(rows_added).alias("r"))
    r = F.col("r")
    counts = rows.groupBy("period").agg(F.count("*").alias("judged"), F.count_if(r > 0).alias("delivered"), F.count_if(r == 0).alias("none"), F.count_if(r.isNull()).alias("unknown"))
    typical = quantiles(rows, ["period"], F.when(r > 0, r), {"typical": 0.5}).withColumn("typical", F.col("typical").cast("bigint"))
    return counts.join(F.broadcast(typical), "period", "left")  # two rows


def column_sketches(df: DataFrame, keys: list[str], columns: list[str], lg_k: int = 15) -> DataFrame:
    """keys, column, rows, sketch: of each column of each key (a table's version, say) a sketch of its distinct values, of bounded size (2 ** lg_k cells). Rows of versions that are stored once are not read again."""
    text = lambda c: F.col(f"`{c}`") if dict(df.dtypes)[c] in ("int", "bigint", "string") else F.col(f"`{c}`").cast("string")
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), *(F.hll_sketch_agg(text(c), lg_k).alias(f"__s{i}") for i, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"__s{i}").alias("sketch")) for i, c in enumerate(columns)))
    return wide.select(*keys, "__rows", F.explode(pairs).alias("p")).select(*keys, "p.column", F.col("__rows").alias("rows"), "p.sketch")


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column, rows, sketch of fewer keys, by the union of the sketches."""
    return sketches.groupBy(*keys, "column").agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def sketched_cardinalities(sketches: DataFrame) -> DataFrame:
    """The sketches with distinct_values, an estimate (near exact far below the sketch's cells, within about 1 % beyond), and share of rows, instead of the sketch."""
    n = F.hll_sketch_estimate("sketch")
    return sketches.select(*(c for c in sketches.columns if c != "sketch"), n.alias("distinct_values"), (n / F.nullif(F.col("rows"), F.lit(0))).alias("share"))


def latest(df: DataFrame, by: str) -> DataFrame:
    """The row of the largest `by`."""
    return df.orderBy(F.desc(by)).limit(1)


def earliest(df: DataFrame, by: str) -> DataFrame:
    """The row of the smallest known `by`."""
    return df.where(F.col(by).isNotNull()).orderBy(by).limit(1)


def not_found(expected: DataFrame, have: DataFrame, key: str, have_key: str) -> DataFrame:
    """The expected rows whose name isn't among the names that there are."""
    return expected.join(have.select(F.col(have_key).alias(key)).distinct(), key, "left_anti")


def bag_union(*parts: DataFrame) -> DataFrame:
    """All rows of tables whose columns may differ; null where a table has no such column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def columns_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that there are, in the order asked for."""
    return df.select(*(c for c in columns if c in df.columns))


def selected(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of the keys that are wanted; a key without a row is an error."""
    missing = [r[key] for r in wanted.select(key).distinct().join(df.select(key).distinct(), key, "left_anti").limit(20).collect()]
    if missing:
        raise KeyError(f"no row of {', '.join(map(str, missing))}")
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def sizes(spark, paths: dict[str, str]) -> DataFrame:
    """name, path, bytes, files of saved tables."""
    out = []
    for name, path in paths.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p)
        out.append((name, path, s.getLength(), s.getFileCount()))
    return spark.createDataFrame(out, "name string, path string, bytes bigint, files bigint")
