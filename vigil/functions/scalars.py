"""Column functions: time, identity, text and numbers, with the null and rounding rules that the rules rely on.

None of these reads the clock; whoever needs the present passes it.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- time ----


def as_utc(df: DataFrame) -> DataFrame:
    """Every timestamp without zone is labelled UTC, not shifted; the session's zone must be UTC. Other columns stay as they are."""
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f"`{f.name}`") for f in df.schema))


def parse_utc(text: Column | str) -> Column:
    """A timestamp from ISO text with or without a zone (UTC then); null for what is none."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end as a double; null if either is."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def iso(ts: Column | str) -> Column:
    """ISO text with zone; microseconds only where there are any."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = (micros(ts) % 1_000_000) == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))


def day(ts: Column) -> Column:
    return F.to_date(ts)


def weekday(ts: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(ts)


# ---- identity ----


def incident_id(rule: Column, workspace: Column, item: Column, occurrence: Column) -> Column:
    """Stable for a rule and an occurrence, however often it is found. A null part counts as the text None, so that parts keep their places."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (rule, workspace, item, occurrence)]
    return F.concat(F.lit("INC-"), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 10))


def fault_id(fault_class: str, item: str, parameters: dict, seed: int) -> str:
    """Stable for a fault's class, target, parameters and seed."""
    digest = hashlib.sha1(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:6]
    return f"{fault_class}-{item}-{digest}-{seed}"


# ---- numbers ----


def rounded(x: Column, digits: int) -> Column:
    """Half to even."""
    return F.bround(x, digits)


def number(x: Column) -> Column:
    """A double, null for what is none."""
    return x.try_cast("double")


def whole_seconds(x: Column) -> Column:
    """Text of the nearest whole number, half to even."""
    return F.bround(x, 0).cast("bigint").cast("string")


def one_digit(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x, 1))


def thousands(x: Column) -> Column:
    """A whole number with commas; 'an unknown number of' for null."""
    return F.coalesce(F.format_number(x, 0), F.lit("an unknown number of"))


# ---- text ----


def short_name(name: Column) -> Column:
    """The last part of a dotted name, without backticks."""
    return F.translate(F.element_at(F.split(name, r"\."), -1), "`", "")


def basename(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def parent(path: Column) -> Column:
    path = F.rtrim(path, F.lit("/"))
    return F.when(F.instr(path, "/") > 0, F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)) - 1)).otherwise(F.lit(""))


def widened(column: Column, unique: Column, separator: str = "#") -> Column:
    """column made nearly unique by what comes after the separator."""
    return F.concat(column.cast("string"), F.lit(separator), unique.cast("string"))


def narrowed(column: Column, separator: str = "#") -> Column:
    """The inverse of widened()."""
    return F.substring_index(column, separator, 1)


def json_object(text: Column) -> Column:
    """From the first brace to the last one; null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def as_json(**values: Column) -> Column:
    """JSON text that keeps nulls."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())), {"ignoreNullFields": "false"})


def python_json_list(items: Column) -> Column:
    """JSON text of an array of strings."""
    return F.to_json(items)


def severity(intervals: Column) -> Column:
    return F.when(intervals >= 6, "high").otherwise("medium")


def not_equal(column: Column, value) -> Column:
    """True where the value differs, and where it is null."""
    return ~column.eqNullSafe(F.lit(value))
