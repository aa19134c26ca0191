"""A seeded star schema: a ledger with repayments, clients, branches and products.

Every value is a function of row number, seed and column (a hash made uniform, then an inverse distribution), so the same
rows come out whatever the partitions, and any part can be made again alone.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.order import running

#: The dimensions' members and weights.
CLIENTS = 45_000
BRANCHES = ("Kumasi Central", "Accra North", "Takoradi", "Tamale", "Cape Coast", "Ho", "Sunyani", "Koforidua", "Wa", "Bolgatanga", "Techiman", "Obuasi")
BRANCH_WEIGHTS = (0.22, 0.19, 0.14, 0.09, 0.07, 0.06, 0.05, 0.05, 0.04, 0.04, 0.03, 0.02)
REGIONS = ("Ashanti", "Greater Accra", "Western", "Northern", "Central", "Volta", "Bono", "Eastern", "Upper West", "Upper East", "Bono East", "Ashanti")
OPENED = (2009, 2011, 2013, 2015, 2014, 2016, 2017, 2012, 2019, 2019, 2020, 2018)
PRODUCTS = ("MICRO-01", "MICRO-02", "SME-01", "SME-02", "AGRI-01", "AGRI-02", "GROUP-01", "EMERG-01")
PRODUCT_NAMES = ("Micro Loan Standard", "Micro Loan Plus", "SME Working Capital", "SME Asset Finance", "Agri Seasonal", "Agri Equipment", "Group Solidarity", "Emergency Bridge")
TERMS = (6, 12, 24, 36, 9, 24, 6, 3)
CHANNELS, CHANNEL_WEIGHTS = ("Branch", "Mobile", "Agent", "USSD", "Web"), (0.31, 0.34, 0.19, 0.11, 0.05)
STATUSES, STATUS_WEIGHTS = ("Posted", "Pending", "Reversed", "Held"), (0.91, 0.05, 0.03, 0.01)
CURRENCIES, CURRENCY_WEIGHTS = ("GHS", "USD", "GBP"), (0.94, 0.05, 0.01)
SEGMENTS, SEGMENT_WEIGHTS = ("Individual", "Group", "Micro-enterprise", "SME"), (0.55, 0.22, 0.15, 0.08)
GRADES, GRADE_WEIGHTS = ("A", "B", "C", "D", "E"), (0.15, 0.30, 0.32, 0.18, 0.05)
METHODS, OFFICERS = ("Cash", "Mobile Money", "Transfer"), 30
#: Monday to Sunday.
DAY_WEIGHTS = (1.0, 1.05, 1.05, 1.0, 1.15, 0.45, 0.08)
AMOUNT_MEAN, AMOUNT_SPREAD, NOON_MEAN, NOON_SPREAD = 6.2, 1.1, 11 * 3600, 2.5 * 3600
LANDING_BASE = 9_000_000
#: Rows that are numbered in one task, about.
NUMBERED = 1 << 20


def uniform(seed: int, column: str, key: Column | None = None) -> Column:
    """A number in (0, 1) for each row number, of a column's own."""
    h = F.xxhash64(F.lit(seed), F.lit(column), F.col("id") if key is None else key)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(seed: int, column: str) -> Column:
    """A standard normal number, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(seed, column + ".r"))) * F.cos(2 * math.pi * uniform(seed, column + ".a"))


def choice(seed: int, column: str, values, weights=None) -> Column:
    weights = weights or [1 / len(values)] * len(values)
    total, at, out, u = sum(weights), 0.0, None, uniform(seed, column)
    for v, w in list(zip(values, weights, strict=True))[:-1]:
        at += w / total
        out = F.when(u < at, v) if out is None else out.when(u < at, v)
    return F.lit(values[-1]) if out is None else out.otherwise(values[-1])


def integer(seed: int, column: str, low: int, high: int) -> Column:
    """From low to high, both in."""
    return (F.lit(low) + F.floor(uniform(seed, column) * (high - low + 1))).cast("bigint")


def trading_day(seed: int, start: date, end: date) -> Column:
    """A day from start to end, Sundays nearly dead: an inverse distribution over the days, looked up by halving in an array."""
    days = [date.fromordinal(o) for o in range(start.toordinal(), end.toordinal() + 1)]
    total, cum, at = sum(DAY_WEIGHTS[d.weekday()] for d in days), [], 0.0
    for d in days:
        at += DAY_WEIGHTS[d.weekday()] / total
        cum.append(at)
    u, low, high = uniform(seed, "TransactionDate"), F.lit(0), F.lit(len(days) - 1)
    bounds = F.array(*(F.lit(x) for x in cum))
    index = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(days)).bit_length())), F.struct(low.alias("l"), high.alias("h")), lambda acc, _: _halve(acc, bounds, u), lambda acc: acc["l"])
    return F.date_add(F.lit(start), index)


def _halve(acc: Column, bounds: Column, u: Column) -> Column:
    mid = F.floor((acc["l"] + acc["h"]) / 2).cast("int")
    over = F.get(bounds, mid) < u
    return F.struct(F.least(F.when(over, mid + 1).otherwise(acc["l"]), acc["h"]).alias("l"), F.when(over, acc["h"]).otherwise(mid).alias("h"))


def ledger(spark: SparkSession, rows: int, seed: int, start: date, end: date, first: int = 1) -> DataFrame:
    ids = spark.range(first, first + rows)
    second = F.least(F.greatest(F.lit(NOON_MEAN) + NOON_SPREAD * normal(seed, "PostedTimestamp"), F.lit(0)), F.lit(86_399)).cast("bigint")
    with_day = ids.withColumn("day", trading_day(seed, start, end))
    return with_day.select(
        F.format_string("TXN-%010d", "id").alias("TransactionID"), integer(seed, "ClientID", 1, CLIENTS).alias("ClientID"), choice(seed, "Branch", BRANCHES, BRANCH_WEIGHTS).alias("Branch"), choice(seed, "ProductCode", PRODUCTS).alias("ProductCode"),
        choice(seed, "Channel", CHANNELS, CHANNEL_WEIGHTS).alias("Channel"), F.col("day").cast("timestamp").alias("TransactionDate"), F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + second).alias("PostedTimestamp"),
        F.round(F.exp(AMOUNT_MEAN + AMOUNT_SPREAD * normal(seed, "Amount")), 2).alias("Amount"), choice(seed, "CurrencyCode", CURRENCIES, CURRENCY_WEIGHTS).alias("CurrencyCode"), choice(seed, "Status", STATUSES, STATUS_WEIGHTS).alias("Status"),
        F.format_string("SRC-%09d", integer(seed, "SourceRef", 1, max(1, rows // 2))).alias("SourceRef"), F.format_string("officer_%03d", integer(seed, "PostedBy", 0, OFFICERS - 1)).alias("PostedBy"),
    )


def repayments(facts: DataFrame, rows: int, seed: int) -> DataFrame:
    """Payments on a third of the ledger's rows, those with the smallest hashes, numbered from 1 in order of the ledger: no row of the ledger is paired twice, whatever the partitions."""
    key = F.xxhash64(F.lit(seed), F.lit("Repayments"), "TransactionID")
    parts = 1 + rows // NUMBERED
    # both the third and the numbers are places in an order that is spread over all tasks
    picked = running(facts.withColumn("k", key), ["k", "TransactionID"], parts=parts).where(F.col("before") < rows // 3).drop("before", "whole").withColumn("id", F.substring("TransactionID", 5, 10).cast("bigint"))
    placed = running(picked, ["id"], parts=parts).withColumn("n", F.col("before") + 1)
    return placed.select(
        F.format_string("RPY-%010d", "n").alias("RepaymentID"), "TransactionID", "ClientID", (F.date_add(F.to_date("TransactionDate"), integer(seed, "RepaymentDate", 28, 89).cast("int"))).cast("timestamp").alias("RepaymentDate"),
        F.round(F.col("Amount") * (0.15 + 0.25 * uniform(seed, "AmountPaid")), 2).alias("AmountPaid"), choice(seed, "Method", METHODS).alias("Method"),
    )


def clients(spark: SparkSession, seed: int) -> DataFrame:
    return spark.range(1, CLIENTS + 1).select(
        F.col("id").alias("ClientID"), F.format_string("CL-%07d", "id").alias("ClientRef"), choice(seed, "Clients.Branch", BRANCHES, BRANCH_WEIGHTS).alias("Branch"), choice(seed, "Segment", SEGMENTS, SEGMENT_WEIGHTS).alias("Segment"),
        F.date_add(F.lit(date(2021, 1, 1)), integer(seed, "RegistrationDate", 0, 1799).cast("int")).cast("timestamp").alias("RegistrationDate"), choice(seed, "RiskGrade", GRADES, GRADE_WEIGHTS).alias("RiskGrade"),
    )


def branches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(BRANCHES, REGIONS, OPENED, strict=True)), "Branch string, Region string, OpenedYear int")


def products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(PRODUCTS, PRODUCT_NAMES, TERMS, strict=True)), "ProductCode string, ProductName string, TermMonths int")


def star(spark: SparkSession, rows: int, seed: int = 4417, start: date = date(2026, 1, 1), end: date = date(2026, 6, 30)) -> dict[str, DataFrame]:
    """All five tables."""
    facts = ledger(spark, rows, seed, start, end)
    return {"Ledger": facts, "Repayments": repayments(facts, rows, seed), "Clients": clients(spark, seed), "Branches": branches(spark), "Products": products(spark)}


def landing_batch(spark: SparkSession, rows: int = 5000, batch_date: date = date(2026, 7, 1), seed: int | None = None) -> DataFrame:
    """A day's file for a pipeline: the ledger's columns, dates as text, ids of their own range. The seed is the date's digits if none is given."""
    seed = int(batch_date.strftime("%Y%m%d")) if seed is None else seed
    made = ledger(spark, rows, seed, batch_date, batch_date, LANDING_BASE + seed % 1_000_000)
    return made.withColumns({"TransactionDate": F.date_format("TransactionDate", "yyyy-MM-dd"), "PostedTimestamp": F.date_format("PostedTimestamp", "yyyy-MM-dd HH:mm:ss")})


def save(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Each table as Parquet under a folder, replacing what is there."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(out[name])
    return out




def main(argv: list[str] | None = None) -> None:
    """python -m vigil.plans.datagen --rows N --seed S --start D --end D --out FOLDER"""
    import argparse

    from vigil.operators.profile import sizes

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--rows", type=int, default=2_000_000)
    p.add_argument("--seed", type=int, default=4417)
    p.add_argument("--start", type=date.fromisoformat, default=date(2026, 1, 1))
    p.add_argument("--end", type=date.fromisoformat, default=date(2026, 6, 30))
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sizes(spark, save(star(spark, a.rows, a.seed, a.start, a.end), a.out)).show(truncate=False)


if __name__ == "__main__":
    main()
