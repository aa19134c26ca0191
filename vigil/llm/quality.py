"""Quality classifier: importance resampling with hashed n-gram models, by Gumbel top-k.

Two generative models give each text a likelihood: one of the target (documents labelled with quality 1 and not as toxic), one of
the raw corpus (every document). Both are bags of words and word pairs, hashed into a table of fixed size. A text's
log importance weight is the sum of log target / raw over those of its n-grams whose ratio is known to differ from one. Adding
Gumbel noise to the log weights and taking the k largest draws k documents without replacement in proportion to their
weights: a document of log weight -1 next to the others' 0 is drawn less often, one of -100 never before them.

- The raw model counts every n-gram of every document. The target model counts a sample of at most FIT_ROWS labelled
  documents (those with the smallest hash of their id), the one bound here.
- A bucket's ratio is (target count + PRIOR) / (expected count + PRIOR), and one where the counts lie within EVIDENCE standard
  deviations of each other: n-grams too rare to judge say nothing, so weights are of the size of the noise unless there is evidence.
- k is not given by hand: it is the number of documents whose weight is above the level that separates those labelled
  documents best that the model was not fitted on; where levels do about as well, the lowest. TEMPERATURE is what the noise is multiplied by: 1 is the plain draw.
- The k-th key is found by counting keys in ever finer bins, never by sorting the corpus or collecting it.

Nulls and the like: a null or empty text has no n-grams and a weight of 0, which is the weight of one that says
nothing; labels whose id or quality is null are left out, a null toxic says nothing; an id with several labels counts as good only if all say so,
and with several texts by the one of least weight.
Rows that repeat have equal keys and are taken or left together. Without labels every document is taken. Other
columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, release, released, span_hashes, stored, text_slices

#: Buckets of the hashed models: 2 ** BITS.
BITS = 20
#: At most so many labelled documents are read to fit the target model and the level.
FIT_ROWS = 20_000
PRIOR, EVIDENCE = 10.0, 4.0
TEMPERATURE = 1.0
TOLERANCE = 0.005
_CHUNK = 1 << 12

#: 0: blanks; 1: ASCII letters, digits and all bytes beyond ASCII; 2: other ASCII. A token is a run of 1 or of 2.
_KINDS = np.full(256, 1, np.uint8)
_KINDS[:128] = 2
_KINDS[48:58] = _KINDS[65:91] = _KINDS[97:123] = 1
_KINDS[[32, 9, 10, 11, 12, 13]] = 0


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each token and each pair of neighbouring tokens of the rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KINDS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    first, last = at[:-1], at[1:]
    real = kind[first] > 0
    first, last = first[real], last[real]
    h = span_hashes(data, first, last, fold=False)
    row = np.searchsorted(offsets, first, "right") - 1
    pair = mix64(h[:-1] * np.uint64(3) + h[1:])[row[:-1] == row[1:]] if len(h) > 1 else h[:0]
    shift = np.uint64(64 - BITS)
    return np.concatenate([h >> shift, pair >> shift]).astype(np.int64), np.concatenate([row, row[:-1][row[:-1] == row[1:]]])


def _counted(batches):
    """Chunks of this task's counts: of all texts, and of those marked good."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        good = np.asarray(batch.column("good").fill_null(False).to_numpy(zero_copy_only=False), bool)
        for at, data, offsets in text_slices(batch.column("text")):
            bucket, row = ngram_buckets(data, offsets)
            counts[0] += np.bincount(bucket, minlength=1 << BITS)
            mine = good[at + row]
            if mine.any():
                counts[1] += np.bincount(bucket[mine], minlength=1 << BITS)
    for which in (0, 1):
        for chunk in range(0, 1 << BITS, _CHUNK):
            part = counts[which, chunk : chunk + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"which": pa.array([which], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})


def _summed(key, data):
    total = np.zeros(_CHUNK, np.int64)
    for part in data.column("counts").to_pylist():
        total += np.frombuffer(part, np.int64)
    return pa.table({"which": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def labelled_sample(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """__id, good, fitted of at most so many labelled ids: those whose ids have the smallest hashes. Seven in ten fit the model, the others the level."""
    good = F.col("quality") == 1
    if "toxic" in labels.columns:
        good = good & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    part = F.pmod(F.xxhash64(F.lit("part"), "__id"), F.lit(10)) < 7
    by_id = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min(good.cast("int")).cast("boolean").alias("good"))
    return by_id.orderBy(F.xxhash64("__id"), "__id").limit(rows).withColumn("fitted", part)


def fit(docs: DataFrame, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> np.ndarray:
    """The log ratio of each bucket. What comes to the driver are the two tables of fixed size."""
    marked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "__id", "left").select("text", (F.col("good") & F.col("fitted")).alias("good"))
    parts = marked.mapInArrow(released(_counted), "which int, chunk int, counts binary")
    counts = np.zeros((2, 1 << BITS), np.int64)
    # first those of the same hash of the task, so that no task ever gets the parts of all others
    form = "which int, chunk int, counts binary"
    mid = parts.withColumn("salt", F.spark_partition_id() % 64).groupBy("which", "chunk", "salt").applyInArrow(_summed, form)
    for r in mid.groupBy("which", "chunk").applyInArrow(_summed, form).collect():
        counts[r.which, r.chunk : r.chunk + _CHUNK] = np.frombuffer(r.counts, np.int64)
    raw, target = counts
    if not target.sum():
        return np.zeros(1 << BITS, np.float32)
    expected = raw * (target.sum() / max(1, raw.sum()))
    sure = np.abs(target - expected) >= EVIDENCE * np.sqrt(expected + 1)
    return np.where(sure, np.log((target + PRIOR) / (expected + PRIOR)), 0).astype(np.float32)


def weights(spark, ratios: np.ndarray):
    """A function from a text column to struct<n, w>: its n-grams and log weight."""
    shared = spark.sparkContext.broadcast(ratios)  # of fixed size: 4 * 2 ** BITS bytes

    @F.arrow_udf("struct<n:long,w:double>")
    def score(text: pa.Array) -> pa.Array:
        table = shared.value
        n, w = np.zeros(len(text), np.int64), np.zeros(len(text))
        for at, data, offsets in text_slices(text):
            bucket, row = ngram_buckets(data, offsets)
            rows = len(offsets) - 1
            n[at : at + rows] = np.bincount(row, minlength=rows)
            w[at : at + rows] = np.bincount(row, weights=table[bucket], minlength=rows)
        release()
        return pa.StructArray.from_arrays([pa.array(n), pa.array(w)], ["n", "w"])

    return score


def gumbel(id_col: str, text_col: str, seed):
    """A standard Gumbel number that depends on nothing but id, text and seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest of the doubles of a column, exactly: four counts of the next 16 bits of those that share the bits so far."""
    bits = stored(keys.select(F.col(column).cast("double")).mapInArrow(_ordered_bits, "b long"), "quality-bits")
    found = None
    for shift in (48, 32, 16, 0):
        left = bits if found is None else bits.where(F.shiftright("b", shift + 16) == found)
        rows = left.groupBy(F.shiftright("b", shift).alias("bin")).count().collect()  # at most 2**16 rows
        for r in sorted(rows, key=lambda r: -r["bin"]):
            found = r["bin"]
            if k <= r["count"]:
                break
            k -= r["count"]
    return _from_bits(found)


def _ordered_bits(batches):
    for batch in batches:
        b = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b))], ["b"])


def _from_bits(b: int) -> float:
    x = np.int64(b)
    return float((x ^ np.int64(0x7FFFFFFFFFFFFFFF) if x < 0 else x).view(np.float64))


def level(scored: list[tuple[float, bool]]) -> float:
    """The lowest weight above which good and bad labelled documents part as well as anywhere, within TOLERANCE of balanced errors; -inf without bad ones."""
    if not scored:
        return float("-inf")
    w, good = np.array([x for x, _ in scored]), np.array([g for _, g in scored])
    if good.all() or not good.any():
        return float("-inf") if good.all() else float("inf")
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    kept_good = good.sum() - np.cumsum(good)
    left_bad = np.cumsum(~good)
    gain = kept_good / good.sum() + left_bad / (~good).sum()
    gain[:-1][w[:-1] == w[1:]] = -1
    best = int(np.argmax(gain >= gain.max() - TOLERANCE))
    return float((w[best] + w[min(best + 1, len(w) - 1)]) / 2)


def draw(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = 17) -> tuple[object, DataFrame, float]:
    """(the function from text to n and w, a stored table __id, n, w, key of docs, the smallest key that is taken); k: as the labelled sample has it."""
    sample = stored(labelled_sample(labels), "quality-sample")
    score = weights(docs.sparkSession, fit(docs, sample, text_col, id_col))
    scored = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), score(F.col(text_col)).alias("s"))
    keys = stored(scored.select("__id", "s.*", (F.col("s.w") + TEMPERATURE * gumbel("__id", "text", seed)).alias("key")), "quality-keys")
    if k is None:
        pairs = keys.join(F.broadcast(sample), "__id").groupBy("__id").agg(F.min("w").alias("w"), F.first("good").alias("good"), F.first("fitted").alias("fitted")).collect()  # at most the sample's ids
        left = [(r["w"], r["good"]) for r in pairs if not r["fitted"]]
        both = len({g for _, g in left}) == 2
        k = keys.where(F.col("w") > level(left if both else [(r["w"], r["good"]) for r in pairs])).count()
    if k >= keys.count():
        return score, keys, float("-inf")
    return score, keys, kth_largest(keys, "key", k) if k > 0 else float("inf")


def resample(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per row of docs: doc_id, n_ngrams, log_weight, key (weight with noise) and kept (among the k largest keys)."""
    _, keys, least = draw(docs, labels, **how)
    return keys.select(F.col("__id").alias("doc_id"), F.col("n").alias("n_ngrams"), F.col("w").alias("log_weight"), "key", (F.col("key") >= least).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = 17) -> DataFrame:
    """The rows of docs that the resampling takes, as they came."""
    score, _, least = draw(docs, labels, id_col, text_col, k, seed)
    return docs.where(score(F.col(text_col))["w"] + TEMPERATURE * gumbel(id_col, text_col, seed) >= least)
