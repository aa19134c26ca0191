"""What the text operators share: tables, the shared folder, and word hashing over Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that the numpy operators hold at once; a longer text is taken whole, alone.
SLICE_BYTES = 1 << 19


_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a folder of this machine serves a master in this process (tests); on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "own" not in _local:
        _local["own"] = "file://" + tempfile.mkdtemp(prefix="vigil-")
    return _local["own"]


#: Rows and bytes of an Arrow batch at most: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to those; lower ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        digits = re.sub(r"\D", "", spark.conf.get(key) or "") or "0"
        if not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives what this Python worker no longer uses back to the machine: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not this C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(over):
    """A function over a task's batches that ends with release()."""

    def run(batches):
        try:
            yield from over(batches)
        finally:
            release()

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: it cuts lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_rows(docs: DataFrame, **keys) -> DataFrame:
    """row (all columns of docs as a struct) and the given columns: whatever docs calls its columns, the names that an operator needs don't clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in keys.items()))


def lower_ascii(text):
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


# ---- bytes, words and hashes, vectorised ----

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(separators: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(separators)] = 1
    return out


#: White space as the contracts have it: blank and 0x09 to 0x0D.
BLANKS = byte_table(b" \t\n\x0b\x0c\r")
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, data, offsets) of consecutive rows; data: uint8 of their UTF-8, offsets: where each row begins, and the end. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    large = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, first word of each row and their number) of the words between separators; words end with their row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = separators[data] == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


#: The random words of a byte at each of the first places of a span; at later ones they are made when met.
_PLACES = 64
_words_of = mix64(mix64(np.arange(256 * _PLACES, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes: the sum of a random word for each (byte, place in the span), mixed with the length. fold: A-Z count as a-z."""
    if not len(first):
        return np.zeros(0, np.uint64)
    begin = np.zeros(len(data), np.int64)
    begin[first] = first
    key = np.arange(len(data)) - np.maximum.accumulate(begin)
    far = np.flatnonzero(key >= _PLACES)
    key <<= 8
    key |= _fold[data] if fold else data
    if len(far):
        far_key = key[far]
        key[far] = 0
    value = _words_of[key]
    if len(far):
        value[far] = mix64(mix64(far_key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix64(total[last] - total[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
