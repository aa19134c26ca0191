"""Source divergence audit by systolic rotation.

For each language, how far the word frequencies of its sources lie from each other, and which terms set a source apart. A group is a source in a
language; its vector gives each of the language's kept terms a smoothed share.

1. One pass counts terms by group, each batch on its own before anything is shuffled, so a source of a third of all rows is a few rows a term.
2. Kept terms of a language are dealt into buckets of about BUCKET terms by hash and numbered; a vector is cut by bucket and compressed. All sums over terms
   are sums over buckets, so memory is bounded by a bucket, however many terms there are.
3. A language's groups are dealt to cells of RESIDENTS. In each bucket a cell's vectors stay in a task, and the other cells' come by, compressed, in the rounds of a
   round-robin tournament: any two cells meet once, in one of the two, which takes turns; the meeting gives both directions. A task holds its
   residents and one peer at a time. Terms are ranked by a heap at the residents, bucket by bucket.

Nulls and the like: null text, lang and source are ''. A group without terms has the smoothed shares of no counts. A language without kept terms gives its pairs a
value of 0 and no terms. Rows that repeat count again. Ties: the smaller item by bytes. Very long texts are taken whole; other columns, whatever
their names, play no part. An empty table gives no rows. Counts up to 9e15 are exact.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _fold, bounded_batches, byte_table, released, span_hashes, stored, text_slices, word_bounds

#: What parts terms: all of ASCII but letters.
NO_TERM = byte_table(bytes(x for x in range(128) if not chr(x).isalpha()))
#: Documents of a language that a kept term is in, at least; what is added to each count; the scale of shares.
LEAST, ADDED, SCALE = 30, 5, 10**9
#: Terms of a bucket, about; groups of a cell; terms that are ranked.
BUCKET, RESIDENTS, TOP = 1 << 16, 8, 50
#: Bytes of text that are counted at once.
SLICE = 2 << 20


def term_counts(docs: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """lang, source, term, n (occurrences), df (rows that hold it)."""

    def count(batches):
        for batch in batches:
            langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
            pair = langs.indices.to_numpy().astype(np.int64) * (len(sources.dictionary) + 1) + sources.indices.to_numpy()
            for at, data, offsets in text_slices(batch.column(2), SLICE):
                low = _fold[data]
                first, last, first_word = word_bounds(low, offsets, NO_TERM)
                if not len(first):
                    continue
                rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first_word))
                h = span_hashes(low, first, last, fold=False)
                # a run for each row and term, then one for each group and term
                by = np.lexsort((h, rows))
                h, rows, first, last = h[by], rows[by], first[by], last[by]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))))
                tf = np.diff(np.append(new, len(h)))
                h, group, first, last = h[new], pair[at + rows[new]], first[new], last[new]
                by = np.lexsort((h, group))
                h, group, first, last, tf = h[by], group[by], first[by], last[by], tf[by]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (group[1:] != group[:-1]))))
                raw = low.tobytes()
                terms = pa.array([raw[a:b].decode() for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)], pa.string())
                df = np.diff(np.append(new, len(h)))
                of_lang, of_source = np.divmod(group[new], len(sources.dictionary) + 1)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of_lang)), sources.dictionary.take(pa.array(of_source)), terms, pa.array(np.add.reduceat(tf, new)), pa.array(df)], ["lang", "source", "term", "n", "df"])

    rows = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    return rows.mapInArrow(released(count), "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def shares(counts: np.ndarray, whole: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (whole + ADDED * terms)), exact."""
    by, rest, out = whole + ADDED * terms, counts + ADDED, np.zeros(len(counts), np.int64)
    for _ in range(3):  # three digits at a time, so that nothing overflows
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


def pack(at: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: places as gaps, and counts, compressed."""
    by = np.argsort(at)
    gaps = np.diff(at[by], prepend=0).astype("<u4")
    return zlib.compress(gaps.tobytes() + counts[by].astype("<i8").tobytes(), 1)


def unpack(packed: bytes | None, size: int) -> np.ndarray:
    """The counts of a vector of that many places."""
    out = np.zeros(size, np.int64)
    if packed is not None:
        raw = zlib.decompress(packed)
        many = len(raw) // 12
        out[np.cumsum(np.frombuffer(raw, "<u4", many))] = np.frombuffer(raw, "<i8", many, 4 * many)
    return out


def _packed(batches):
    """From keys, at (places) and counts to keys and the packed vector."""
    for batch in batches:
        at, counts = batch.column("at"), batch.column("counts")
        made = [pack(at[i].values.to_numpy(), counts[i].values.to_numpy()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("lang", "bucket", "source")] + [pa.array(made, pa.binary())], ["lang", "bucket", "source", "packed"])


def ranked(values: np.ndarray, most: int) -> list[int]:
    """The places of the largest values above 0, largest first, of equal ones the smaller place."""
    at = np.flatnonzero(values > 0)
    if len(at) > most:
        at = at[values[at] >= np.partition(values[at], -most)[-most]]
    return [i for _, i in heapq.nsmallest(most, zip((-values[at]).tolist(), at.tolist(), strict=True))]


OUT = "lang string, source string, part string, item string, value long"


def _rotate(batches):
    """From a cell's rows in order (the language's, its residents', then its peers' by round) to the values of each meeting and the residents' terms."""
    key, residents, rows = None, [], []

    def flush():
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(columns)], ["lang", "source", "part", "item", "value"])

    def meet(mine, p, source):
        value = int(np.abs(mine[1] - p).sum())
        rows.append((key[0], mine[0], "pair", source, value))
        rows.append((key[0], source, "pair", mine[0], value))

    for batch in batches:
        for r in batch.to_pylist():
            now = (r["lang"], r["bucket"], r["cell"])
            if now != key:
                key, residents = now, []
                terms = r["words"].split(" ") if r["words"] else []
                whole = shares(unpack(r["packed"], len(terms)), r["n"], r["v"])
                continue
            counts = unpack(r["packed"], len(terms))
            p = shares(counts, r["n"], r["v"])
            for mine in residents:
                meet(mine, p, r["source"])
            if r["round"] < 0:
                residents.append((r["source"], p))
                rows += [(key[0], r["source"], "term", terms[i], int(p[i] - whole[i])) for i in ranked(np.where(counts > 0, p - whole, 0), TOP)]
            if len(rows) > 10_000:
                yield flush()
    if rows:
        yield flush()


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """lang, source, part, item, value, rank. pair: each other source of the language and how far it is; term: the TOP terms that are more frequent than in the language."""
    bounded_batches(docs.sparkSession)
    lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang_col, source_col))
    counts = stored(term_counts(docs, lang, source, F.col(f"`{text_col}`")), "divergence-counts")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df"), "divergence-kept")

    # groups in order, their sizes and cells; languages, their buckets
    groups = docs.select(lang.alias("lang"), source.alias("source")).distinct()
    sizes = counts.join(kept, ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("i"))
    groups = stored(groups.withColumn("cell", F.floor(F.col("i") / RESIDENTS).cast("int")).drop("i"), "divergence-groups")
    langs = groups.groupBy("lang").agg((F.max("cell") + 1).alias("cells")).join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole")), "lang", "left")
    langs = stored(langs.na.fill(0, ["v", "whole"]).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("v") / BUCKET)).cast("int")), "divergence-langs")

    # terms in their places
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")
    placed = kept.join(langs.select("lang", "buckets"), "lang").select("lang", "term", "total", bucket.alias("bucket"))
    placed = stored(placed.withColumn("at", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term")) - 1), "divergence-places")  # about BUCKET rows a window
    vectors = counts.join(placed.drop("total"), ["lang", "term"]).select("lang", "bucket", "source", "at", "n").unionByName(placed.select("lang", "bucket", F.lit(None).cast("string").alias("source"), "at", F.col("total").alias("n")))
    listed = F.collect_list(F.struct("at", "n"))
    vectors = vectors.groupBy("lang", "bucket", "source").agg(listed.alias("x")).select("lang", "bucket", "source", F.col("x.at").alias("at"), F.col("x.n").alias("counts"))
    vectors = stored(vectors.mapInArrow(released(_packed), "lang string, bucket int, source string, packed binary"), "divergence-vectors")
    words = placed.groupBy("lang", "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]), " ").alias("words"))

    every = langs.select("lang", "cells", "v", "whole", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    none = F.lit(None).cast("string")
    of_lang = every.join(words, ["lang", "bucket"], "left").join(vectors.where("source is null").select("lang", "bucket", "packed"), ["lang", "bucket"], "left")
    of_lang = of_lang.select("lang", "bucket", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(-2).alias("round"), none.alias("source"), F.col("whole").alias("n"), "v", "packed", "words")
    own = every.join(groups, "lang").join(vectors, ["lang", "bucket", "source"], "left").select("lang", "bucket", "cell", "cells", "source", "n", "v", "packed")
    residents = own.select("lang", "bucket", "cell", F.lit(-1).alias("round"), "source", "n", "v", "packed", none.alias("words"))
    peers = own.select("lang", "bucket", F.explode(hosts(F.col("cell"), F.col("cells"))).alias("h"), "source", "n", "v", "packed").select("lang", "bucket", F.col("h.cell").alias("cell"), F.col("h.round").alias("round"), "source", "n", "v", "packed", none.alias("words"))
    dealt = of_lang.unionByName(residents).unionByName(peers).repartition("lang", "bucket", "cell").sortWithinPartitions("lang", "bucket", "cell", "round", "source")
    found = stored(dealt.mapInArrow(released(_rotate), OUT), "divergence-found")

    summed = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = summed.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= TOP))


def hosts(cell: Column, cells: Column) -> Column:
    """The (cell, round) that a cell's vectors travel to. In a round-robin tournament of an even number of cells any two meet once; which of the two is the host takes turns, the other's vectors travel."""
    even = cells + cells % 2
    turn = even - 1

    def other(r):
        mine = F.when(cell == turn, r * (even / 2).cast("int") % turn).when(2 * cell % turn == r, turn).otherwise(F.pmod(r - cell, turn))
        return F.struct(mine.cast("int").alias("cell"), r.cast("int").alias("round"))

    met = F.transform(F.when(turn > 0, F.sequence(F.lit(0), turn - 1)).otherwise(F.array().cast("array<int>")), other)
    away = lambda x: (x["cell"] < cells) & ((((x["cell"] + cell) % 2 == 0) & (x["cell"] < cell)) | (((x["cell"] + cell) % 2 == 1) & (x["cell"] > cell)))
    return F.filter(met, away)


#: The same over all pairs of sources.
ORACLE = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, r, unnest(ts) AS term FROM d), k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS whole FROM k GROUP BY 1), f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, total FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS whole FROM f GROUP BY 1, 2),
p AS (SELECT f.lang, f.source, term, n, 1 + (1000000000 * (n + 5)) // (s.whole + 5 * v) AS p, 1 + (1000000000 * (total + 5)) // (l.whole + 5 * v) AS q FROM f JOIN s USING (lang, source) JOIN l ON l.lang = f.lang),
m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o) SELECT * FROM z WHERE part = 'pair' OR rank <= 50"""
