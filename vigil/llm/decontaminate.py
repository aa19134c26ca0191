"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised word windows, probed by every window of every text.

All of it is DataFrame functions. One scan of the texts hashes their windows; a hash join on the hashes finds those of
the benchmark, and each is verified by its words; what remains for the one shuffle are the hits and one row a document.

Nulls and the like: a null or empty text has no words and no hits. A null id is a document like others. Rows that
repeat (same id, same text) each return a row. A benchmark item without words has no window; hits of an item whose
id is null count, but it has no place in the list of ids. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, whole_rows

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OWN = "array<struct<at:int,len:int,h:bigint>>"
#: Up to so many bytes of benchmark text the windows are broadcast (some 20 times as much memory); beyond, a sort-merge join serves.
BROADCAST_BYTES = 4 << 20


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. A split: extracting all matches would copy the text for each."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _hash(hashes: Column, first: Column, length: int) -> Column:
    """The hash of so many words, of their own hashes. Single elements are read: a slice would copy the whole array for each window."""
    return F.xxhash64(*(F.get(hashes, first + j) for j in range(length)))


def _windows(hashes: str, length: int) -> Column:
    """Structs of position (from 1), number of words and hash, of all windows of so many words."""
    n = F.size(hashes)
    made = F.transform(F.sequence(F.lit(0), n - length), lambda i: F.struct((i + 1).alias("at"), F.lit(length).alias("len"), _hash(F.col(hashes), i, length).alias("h")))
    return F.when(n >= length, made)


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """h, win, items: each distinct window, its hash, and the ids of the items that have it. An item of fewer than n words is one window."""
    split = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("ws"))
    k = F.least(F.size("ws"), F.lit(n))
    made = F.when(k > 0, F.transform(F.sequence(F.lit(1), F.size("ws") - k + 1), lambda i: F.slice(F.col("ws"), i, k)))
    each = split.select("item", F.explode(made).alias("w")).select("item", F.transform("w", lambda w: F.xxhash64(w)).alias("hs"), F.array_join("w", " ").alias("win"))
    by_length = F.coalesce(*(F.when(F.size("hs") == j, _hash(F.col("hs"), F.lit(0), j)) for j in range(1, n + 1)))
    each = each.select("item", by_length.alias("h"), "win")
    return each.groupBy("h", "win").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13) -> DataFrame:
    """Per row of docs: id, text_hash, n_words, spans (disjoint sorted structs of first word from 1 and end), n_hit, items (sorted strings)."""
    sizes = benchmark.select(F.size(words(F.col(item_text_col))).alias("k"), F.octet_length(item_text_col).alias("b"))
    row = sizes.agg(F.collect_set(F.when(F.col("k") > 0, F.least("k", F.lit(n)))).alias("lens"), F.sum("b").alias("bytes")).first()  # at most n numbers
    windows = benchmark_windows(benchmark, item_col, item_text_col, n)
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), words(F.col(text_col)).alias("ws"))
    if (row.bytes or 0) > BROADCAST_BYTES:
        return _spans(_met_by_merge(split, windows, sorted(row.lens)))
    windows = F.broadcast(windows)
    own = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("h")))
    split = split.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    every = F.concat(own, *(F.coalesce(_windows("hs", k), F.array().cast(OWN)) for k in sorted(row.lens)))
    # the array of windows is made in a step of its own: exploding (outer, so that no filter on the array is pushed below it) and probing are then compiled, and the words are read only where a hash is met
    made = split.select("id", "text_hash", "ws", F.size("ws").alias("n_words"), every.alias("every"))
    rows = made.select("id", "text_hash", "ws", "n_words", F.explode_outer("every").alias("w")).select("id", "text_hash", "ws", "n_words", "w.*")
    same = F.col("win") == F.array_join(F.slice(F.col("ws"), F.greatest("at", F.lit(1)), F.col("len")), " ")
    met = rows.join(windows, "h", "left").where((F.col("at") == 0) | (F.col("items").isNotNull() & same)).select("id", "text_hash", "n_words", "at", "len", "items")
    grouped = met.groupBy("id", "text_hash", "n_words").agg(
        F.sum((F.col("at") == 0).cast("int")).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("at") > 0, F.struct("at", (F.col("at") + F.col("len")).alias("end"))))).alias("found"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string"))).alias("items"),
    )
    return _spans(grouped)


def _met_by_merge(split: DataFrame, windows: DataFrame, lens: list[int]) -> DataFrame:
    """What a benchmark too large to broadcast is met by: the windows' hashes and places alone go through the exchange, and the words of a document come back, once, to those that are met."""
    base = split.groupBy("id", "text_hash").agg(F.count("*").cast("int").alias("copies"), F.first("ws").alias("ws")).withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    every = F.concat(F.array().cast(OWN), *(F.coalesce(_windows("hs", k), F.array().cast(OWN)) for k in lens))
    slim = base.select("id", "text_hash", F.explode(every).alias("w")).select(F.col("id").alias("i"), F.col("text_hash").alias("t"), "w.*")
    own = lambda a, b: F.col(a).eqNullSafe(F.col("id")) & (F.col(b) == F.col("text_hash"))
    met = slim.join(windows.hint("merge"), "h").join(base.select("id", "text_hash", "ws"), own("i", "t"))
    met = met.where(F.col("win") == F.array_join(F.slice("ws", F.col("at"), F.col("len")), " "))
    found = met.groupBy("i", "t").agg(
        F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("found"), F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string"))).alias("items"),
    )
    out = base.select("id", "text_hash", F.size("ws").alias("n_words"), "copies").join(found, own("i", "t"), "left")
    return out.select("id", "text_hash", "n_words", "copies", F.coalesce("found", F.array().cast("array<struct<at:int,end:int>>")).alias("found"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _spans(grouped: DataFrame) -> DataFrame:
    """From the distinct places that are hit to disjoint spans and their words, a row for each copy of a document."""
    merged = F.expr("""aggregate(found, cast(array() as array<struct<at:int,end:int>>), (acc, x) ->
        if(size(acc) > 0 and x.at <= acc[size(acc) - 1].end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('at', acc[size(acc) - 1].at, 'end', greatest(acc[size(acc) - 1].end, x.end)))),
           concat(acc, array(x))))""")
    covered = F.expr("aggregate(found, named_struct('n', 0, 'end', 1), (acc, x) -> named_struct('n', acc.n + greatest(0, x.end - greatest(acc.end, x.at)), 'end', greatest(acc.end, x.end)), acc -> acc.n)")
    out = grouped.select("id", "text_hash", "n_words", merged.alias("spans"), covered.alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.drop("copy")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what hits() returns."""
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def _with_hits(docs: DataFrame, benchmark: DataFrame, keep, how: str, id_col: str, text_col: str, n: int) -> DataFrame:
    """row (a row of docs) and text, joined in such a way with the spans of the rows of hits that are to be kept."""
    found = hits(docs, benchmark, id_col, text_col, n=n).where(keep).select("id", "text_hash", "spans").distinct()
    rows = whole_rows(docs, own_id=F.col(id_col), own_hash=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), text=F.col(text_col))
    return rows.join(found, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), how)


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """docs, as they came, without those that the rule calls contaminated: a hit, and a twentieth of the words or more are hit. Rows without text or words stay; rows that repeat go or stay together; columns may have any names."""
    return _with_hits(docs, benchmark, is_contaminated(), "left_anti", id_col, text_col, n).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """docs with the words that are hit, and what stands before each of them, cut out of the text; other texts, null ones too, stay as they are. Columns may have any names."""
    marked = _with_hits(docs, benchmark, F.col("n_hit") > 0, "left", id_col, text_col, n)
    parts = F.regexp_extract_all("text", F.lit(rf"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*{WORD}"), F.lit(0))
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    marked = marked.select("row", "text", "spans", F.when(F.col("spans").isNotNull(), parts).alias("parts"), tail.alias("tail"))
    left = F.filter("parts", lambda x, i: ~F.exists("spans", lambda s: (s["at"] <= i + 1) & (i + 1 < s["end"])))
    cut = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.ltrim(F.concat(F.array_join(left, ""), F.col("tail"))))
    return marked.select(*(cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
k AS (SELECT DISTINCT least(len(ws), 13) AS k FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k WHERE len(ws) >= k)),
h AS (SELECT r, i, k, item_id FROM dw JOIN bw USING (win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
