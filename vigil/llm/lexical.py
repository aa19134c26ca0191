"""Ranked lexical search with dual-sorted wavelet trees.

Documents are dealt into shards of bounded size. A shard keeps, for the terms that queries ask for, one sequence of document numbers: each term's
postings side by side, ordered by falling impact. A wavelet tree over that sequence parts it by the numbers' bits from the highest down and keeps the order within each
part, so a node stands for a range of documents and each term's postings in it are a range of positions, of which the first has the
largest impact. So the sequence is sorted by impact and can be walked by document at once.

A query starts at the root with its terms' ranges. Its best nodes by bound, the sum of the terms' weights times their first impacts, give way to
their children first; at a single document the bound is its score. When no open node reaches the k-th best score the rest is left unread. That score is carried from
shard to shard in a task. Results are exact; the shards' best meet in one top-k.

Queries are read in blocks of bounded size: a block's terms and weights are what is sent to all tasks. Documents are tokenized once a block.

Nulls and the like: a null text has no terms; a document without terms doesn't count. Rows that repeat are documents of their own, and may take
several ranks. Rows of items that repeat an id are one item with all of their terms; a null id is an id like others. A null doc_id comes after the others of its
score. Ties: the smaller doc_id. Items without a document above 0 have no rows; empty tables give none. Very long texts are taken whole;
terms are told apart by 64-bit hashes. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, byte_table, released, span_hashes, stored, text_slices, word_bounds

#: What parts terms: all of ASCII but letters and digits.
NO_TERM = byte_table(bytes(x for x in range(128) if not chr(x).isalnum()))
#: Documents and postings of a shard at most (a document with more postings is one alone); nodes opened at once; bytes of items in a block, about.
SHARD_DOCS, SHARD_POSTINGS, OPENED, BLOCK_BYTES = 8192, 500_000, 64, 16 << 20
_NULL_ID = np.iinfo(np.int64).max


def _terms(column: pa.Array):
    """(first row, hashes of terms, first term of each row and their number) of consecutive rows."""
    for at, data, offsets in text_slices(column):
        first, last, first_word = word_bounds(data, offsets, NO_TERM)
        yield at, span_hashes(data, first, last), first_word


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, terms (distinct hashes) of each row."""
    kind = items.schema[item_id].dataType

    def read(batches):
        for batch in batches:
            for at, h, first in _terms(batch.column(1)):
                sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "terms"])

    schema = T.StructType([T.StructField("item_id", kind), T.StructField("terms", T.ArrayType(T.LongType()))])
    return items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).mapInArrow(released(read), schema)


def matches(docs: DataFrame, doc_id: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the sorted vocabulary of hashes), tf of each document that has terms."""
    asked = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block

    def read(batches):
        vocab = asked.value
        for batch in batches:
            for at, h, first in _terms(batch.column(1)):
                n = np.diff(first)
                place = np.minimum(np.searchsorted(vocab, h), max(len(vocab) - 1, 0))
                hit = vocab[place] == h if len(vocab) else np.zeros(len(h), bool)
                rows = np.repeat(np.arange(len(n)), n)[hit]
                pair, tf = np.unique(rows * (len(vocab) + 1) + place[hit], return_counts=True)
                row, term = np.divmod(pair, len(vocab) + 1)
                ends = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, tf)]
                made = pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
                yield made.filter(pa.array(n > 0))

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(released(read), "doc_id long, n long, terms array<int>, tf array<int>")


class Shard:
    """The wavelet tree of one shard's postings. Levels from the highest bit down; at each, `ones` counts the 1 bits before each position and `impacts` are those of the positions."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int):
        """ids: of the documents, ascending; a posting: place of its document in ids, term, impact."""
        by = np.lexsort((docs, -impacts, terms))
        sequence, here = docs[by].astype(np.int32), impacts[by].astype(np.int32)
        self.ids, self.starts = ids, np.searchsorted(terms[by], np.arange(vocabulary + 1)).astype(np.int32)
        self.depth = max(1, int(len(ids) - 1).bit_length())
        self.ones, self.zeros, self.impacts = np.zeros((self.depth, len(sequence) + 1), np.int32), np.zeros(self.depth, np.int32), np.zeros((self.depth + 1, len(sequence) + 1), np.int32)
        for level in range(self.depth):
            self.impacts[level, :-1] = here
            bit = (sequence >> (self.depth - 1 - level)) & 1
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = len(bit) - self.ones[level, -1]
            order = np.concatenate((np.flatnonzero(bit == 0), np.flatnonzero(bit)))
            sequence, here = sequence[order], here[order]
        self.impacts[self.depth, :-1] = here

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """(places of documents, scores, nodes opened) of the k best of at least that score; of equal scores the smaller places."""
        lo, hi = self.starts[terms], self.starts[terms + 1]
        there = hi > lo
        lo, hi, weights = lo[there][None], hi[there][None], weights[there]
        found_at, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        level, node, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), self.impacts[0, lo].astype(np.int64) @ weights
        opened = 0
        while len(bound):
            best = np.argpartition(bound, -OPENED)[-OPENED:] if len(bound) > OPENED else np.arange(len(bound))
            if bound[best].max() < least:
                break
            opened += len(best)
            x, v, a, b = level[best], node[best], lo[best], hi[best]
            ones_a, ones_b = self.ones[x[:, None], a], self.ones[x[:, None], b]
            zeros = self.zeros[x][:, None]
            # the children of 0 bits, then those of 1 bits
            new_lo, new_hi = np.concatenate((a - ones_a, zeros + ones_a)), np.concatenate((b - ones_b, zeros + ones_b))
            new_level, new_node = np.concatenate((x, x)) + 1, np.concatenate((2 * v, 2 * v + 1))
            first = np.where(new_hi > new_lo, self.impacts[new_level[:, None], new_lo], 0)
            new_bound = first.astype(np.int64) @ weights
            leaf = new_level == self.depth
            ok = leaf & (new_bound >= least) & (new_bound > 0)
            if ok.any():
                found_at, found = np.concatenate((found_at, new_node[ok])), np.concatenate((found, new_bound[ok]))
                top = np.lexsort((found_at, -found))[:k]
                found_at, found = found_at[top], found[top]
                if len(found) == k:
                    least = max(least, int(found[-1]))
            rest = np.ones(len(bound), bool)
            rest[best] = False
            rest &= bound >= least
            ok = ~leaf & (new_bound >= least)
            level, node, bound = np.concatenate((level[rest], new_level[ok])), np.concatenate((node[rest], new_node[ok])), np.concatenate((bound[rest], new_bound[ok]))
            lo, hi = np.concatenate((lo[rest], new_lo[ok])), np.concatenate((hi[rest], new_hi[ok]))
        return found_at, found, opened


def _shards(batches, whole: int, length: int, vocabulary: int):
    """Shards of consecutive documents, of bounded size."""
    ids, n, terms, tf, sizes = [], [], [], [], []

    def made():
        key = np.concatenate(ids)
        size = np.concatenate(sizes)
        by = np.argsort(key, kind="stable")
        place = np.empty(len(key), np.int64)
        place[by] = np.arange(len(key))
        docs = np.repeat(place, size)
        m = np.repeat(10 + 90 * np.concatenate(n) * whole // length, size)
        f = np.concatenate(tf).astype(np.int64)
        out = Shard(key[by], docs, np.concatenate(terms).astype(np.int64), 1_000_000_000 * f // (1000 * f + 8 * m), vocabulary)
        for part in (ids, n, terms, tf, sizes):
            part.clear()
        return out

    docs = postings = 0
    for batch in batches:
        own = batch.column("doc_id").fill_null(_NULL_ID).to_numpy()
        ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
        values = [batch.column(c).values.to_numpy() for c in ("terms", "tf")]
        at = 0
        while at < batch.num_rows:
            to = min(batch.num_rows, at + SHARD_DOCS - docs, int(np.searchsorted(ends, ends[at] + SHARD_POSTINGS - postings, "right")) - 1)
            if to <= at and docs:
                yield made()
                docs = postings = 0
                continue
            to = max(to, at + 1)
            ids.append(own[at:to]), n.append(batch.column("n").to_numpy()[at:to]), sizes.append(np.diff(ends[at : to + 1]))
            terms.append(values[0][ends[at] : ends[to]]), tf.append(values[1][ends[at] : ends[to]])
            docs, postings, at = docs + to - at, postings + int(ends[to] - ends[at]), to
    if docs:
        yield made()


def _block(docs: DataFrame, items: list, doc_id: str, text: str, k: int) -> DataFrame:
    """item (place in items), doc_id, score: the k best of each task. items: sorted arrays of hashes."""
    vocabulary = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
    found = stored(matches(docs, doc_id, text, vocabulary), "lexical-matches")
    whole, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # as many as the block's terms, at most
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in zip(held.column("term").to_pylist(), held.column("df").to_pylist(), strict=True):
        weights[term] = math.floor(1000 * math.log((2 * whole + 2) / (2 * df + 1)))
    places = [np.searchsorted(vocabulary, x) for x in items]
    places = [x[weights[x] > 0] for x in places]
    sent = docs.sparkSession.sparkContext.broadcast((places, weights))  # of one block

    def search(batches):
        asked, weight = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for shard in _shards(batches, whole, length, len(weight)):
            for i, terms in enumerate(asked):
                ids, scores = best[i]
                at, more, _ = shard.search(terms, weight[terms], k, int(scores[-1]) if len(scores) == k else 1)
                if len(at):
                    ids, scores = np.concatenate((ids, shard.ids[at])), np.concatenate((scores, more))
                    top = np.lexsort((ids, -scores))[:k]
                    best[i] = ids[top], scores[top]
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b[0]) for b in best])
        if len(item):
            ids = np.concatenate([b[0] for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _NULL_ID), pa.array(np.concatenate([b[1] for b in best]))], ["item", "doc_id", "score"])

    return found.mapInArrow(released(search), "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item, of scores above 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = items.schema[item_id].dataType
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{item_text}`"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    asked = item_terms(items, item_id, item_text)
    out = None
    for b in range(blocks):
        by_id: dict = {}
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator():  # one block of items
            mine = np.array(row["terms"], np.int64).view(np.uint64)
            by_id[row["item_id"]] = np.union1d(by_id[row["item_id"]], mine) if row["item_id"] in by_id else mine
        ids = spark.createDataFrame(list(enumerate(by_id)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        part = _block(docs, list(by_id.values()), doc_id, text, k).join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The same by all postings of the items' terms.
ORACLE = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents), n AS (SELECT *, len(ts) AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
u AS (SELECT r, doc_id, n, unnest(ts) AS term FROM n), tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
c AS (SELECT item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY ALL),
z AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0) SELECT * FROM z WHERE rank <= 10"""
