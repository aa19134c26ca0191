"""MinHash near-duplicates with odd sketches.

Documents are sets of word shingles. One pass over the texts makes, for each, a fingerprint of its set, MinHash samples
and an odd sketch: the samples folded into a bitmap by parity, so that the population count of two bitmaps' XOR tells
how many samples differ. Documents of equal fingerprint are one node from then on. Nodes that share a band of samples
are candidates; the sketches drop those that are plainly apart; what is left is confirmed on the full sets.

Candidates are not all pairs of a band's bucket. First each member meets the bucket's leader, the member that shares most buckets. Buckets whose
members are not yet all in one component by then are taken again, and only members of different components of them
meet, once, by a join that drops the far ones by size and a finer sketch before it emits a pair. So a bucket of near copies costs a
pair a member, and no link that matters for the components is lost: members of one component need no further links.

BANDS bands of ROWS samples miss a pair at the threshold with a probability of (1 - 0.8**ROWS)**BANDS, under 1e-6;
the sketches' margins are 6.5 standard deviations of the bits that differ. Components come from rounds of the smallest
label over stored tables.

Nulls and the like: a text that is null, empty or blank has an empty set and is linked with nothing. A text with fewer
words than a shingle is one shingle, its whole sequence. Rows that repeat an id are one document with several texts:
all of their links count. A row with a null id is linked with nothing and has a null component. Ties: the smallest id.
Very long texts are taken whole. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, mix64, released, span_hashes, stored, text_slices, whole_rows, word_bounds

ROWS, BANDS = 6, 48
SKETCH_WORDS = 16
_SAMPLES = ROWS * BANDS
#: The finer sketches of nodes whose buckets are taken again: their samples, words and margin.
FINE_SAMPLES, FINE_WORDS, FINE_MARGIN = 4096, 128, 0.0515
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 32, FINE_SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_MASKS = _rng.integers(0, 1 << 32, FINE_SAMPLES, dtype=np.uint64).astype(np.uint32)
#: How far the sketches' estimate of the similarity may lie below the truth: for both kinds, 6.5 standard deviations of the bits that differ at 0.8 (first: mean 103, deviation 11.7; finer: 1349, 39.7).
MARGIN = 0.18
#: Up to so many ids (8 bytes each) the texts to confirm are found by a broadcast; beyond, by a shuffle.
BROADCAST_IDS = 2_000_000


def shingle_sets(texts: pa.Array, words: int = 2):
    """The sorted distinct hashes of the word shingles of each text, in order."""
    for _, data, offsets in text_slices(texts):
        first, last, first_word = word_bounds(data, offsets, BLANKS)
        h = span_hashes(data, first, last)
        roll = h
        for k in range(1, words):
            roll = mix64(roll[:-1] * np.uint64(0x2545F4914F6CDD1D) + h[k:]) if len(roll) > 1 else roll[:0]
        for a, b in zip(first_word[:-1], first_word[1:], strict=True):
            if b - a >= words:
                yield np.unique(roll[a : b - words + 1])
            elif b > a:
                whole = h[a]
                for x in h[a + 1 : b]:
                    whole = mix64((whole * np.uint64(0x2545F4914F6CDD1D) + x)[None])[0]
                yield np.array([mix64((whole ^ np.uint64(b - a))[None])[0]], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def samples(found: np.ndarray, many: int = _SAMPLES) -> np.ndarray:
    """The MinHash samples of a set of hashes."""
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    best = np.full(many, 0xFFFFFFFF, np.uint32)
    step = (1024 * _SAMPLES) // many
    room = np.empty((min(len(low), step), many), np.uint32)
    for at in range(0, len(low), step):
        part = low[at : at + step, None]
        made = room[: len(part)]
        np.bitwise_xor(part, _MASKS[:many], out=made)
        np.multiply(made, _FACTORS[:many], out=made)
        np.minimum(best, made.min(axis=0), out=best)
    return best


def odd_sketch(best: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """The samples folded into so many words of 64 bits by parity."""
    at = (mix64(best.astype(np.uint64) | (np.arange(len(best), dtype=np.uint64) << np.uint64(32))) % np.uint64(64 * words)).astype(np.int64)
    bits = np.bincount(at, minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def most_different(threshold: float, many: int = _SAMPLES, words: int = SKETCH_WORDS, margin: float = MARGIN) -> int:
    """The most bits by which two sketches differ that may yet be of sets as similar as the threshold."""
    n, apart = 64 * words, 2 * many * (1 - (threshold - margin))
    return int(np.ceil(n / 2 * (1 - (1 - 2 / n) ** apart)))


def _signed(texts: pa.Array, words: int, fine: bool = False) -> list[pa.Array]:
    sizes, prints, sketches, bands = [], [], [], []
    salt = np.arange(BANDS, dtype=np.uint64)
    place = np.arange(1, ROWS + 1, dtype=np.uint64)
    for found in shingle_sets(texts, words):
        sizes.append(len(found))
        if not len(found):
            prints.append(None), sketches.append(None), bands.append(None)
            continue
        a = np.bitwise_xor.reduce(mix64(found))
        b = np.add.reduce(mix64(found + np.uint64(0x632BE59BD9B4E019)))
        prints.append(a.tobytes() + b.tobytes())
        best = samples(found)
        sketches.append(odd_sketch(samples(found, FINE_SAMPLES), FINE_WORDS) if fine else odd_sketch(best))
        rows = best.reshape(BANDS, ROWS).astype(np.uint64)
        bands.append(mix64((mix64(rows + (place << np.uint64(32))) * (place * np.uint64(2) + np.uint64(1))).sum(axis=1) + mix64(salt)).view(np.int64))
    return [pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, fine: bool = False) -> DataFrame:
    """id, n, fp (of the set; null if empty), sketch, bands of each row."""

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), *_signed(part.column(1), words, fine)], ["id", "n", "fp", "sketch", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(released(sign), "id long, n long, fp binary, sketch array<bigint>, bands array<bigint>")


def _confirm(threshold: float, words: int):
    """From (a, b, ta, tb) to the (a, b) whose sets are as similar as the threshold (in hundredths, exactly)."""
    hundredths = round(threshold * 100)

    def confirm(batches):
        for batch in batches:
            a, b = [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = zip(shingle_sets(part.column("ta"), words), shingle_sets(part.column("tb"), words), strict=True)
                for i, (x, y) in enumerate(sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= hundredths * (len(x) + len(y) - both) and both:
                        a.append(part.column("a")[i].as_py())
                        b.append(part.column("b")[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return confirm


def _near(x: str, y: str, threshold: float, words: int = SKETCH_WORDS, most: int | None = None):
    """The condition that two nodes' sizes and sketches allow the threshold."""
    apart = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(words)), F.lit(0))
    n, m, h = F.col(f"{x}.n"), F.col(f"{y}.n"), F.lit(round(threshold * 100))
    return (n * h <= m * 100) & (m * h <= n * 100) & (apart <= (most_different(threshold) if most is None else most))


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that is reachable, of the nodes that have links (a, b). Rounds over stored tables until nothing changes."""
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")), "neardup-edges")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "neardup-labels")
    while True:
        sent = both.join(labels, "node").select(F.col("other").alias("node"), "label")
        jump = labels.select("node", F.col("label").alias("to")).join(labels.select(F.col("node").alias("to"), "label"), "to").select("node", "label")
        own = labels.select("node", "label", F.col("label").alias("was"))
        least = own.unionByName(sent, allowMissingColumns=True).unionByName(jump, allowMissingColumns=True).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        new = stored(least, "neardup-labels")
        labels = new.select("node", "label")
        if new.where("label < was").isEmpty():
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5) -> DataFrame:
    """Per row of docs: id, n_shingles, component (smallest id reachable by links). Two sets are linked if the common shingles are such a share of all of theirs."""
    signed = stored(signatures(docs, id_col, text_col, words), "neardup-signatures")
    full = signed.where("id is not null and fp is not null")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # a node for each distinct set: the smallest id that has it
    nodes = stored(full.groupBy("fp").agg(F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("n", "sketch", "bands"))), "neardup-nodes")
    info = nodes.select("node", "n", "sketch")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = stored(keys.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "neardup-buckets")
    members = stored(keys.join(shared, "bucket"), "neardup-members")
    # a bucket is led by the member that meets others most often: in a group of near copies, the text that they were made from
    met_by = stored(members.groupBy("node").agg((F.sum("m") * 65536 + F.pmod(F.xxhash64("node"), F.lit(65536))).alias("meets")), "neardup-meets")
    lead = stored(members.select("bucket", "node").join(met_by, "node").groupBy("bucket").agg(F.max_by("node", "meets").alias("lead")), "neardup-lead")

    first = members.join(lead, "bucket").where("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    x, y = F.struct("n", "sketch").alias("x"), F.struct("n", "sketch").alias("y")
    first = first.join(info.select(F.col("node").alias("b"), y), "b").join(info.select(F.col("node").alias("a"), x), "a")
    pairs = stored(first.where(_near("x", "y", threshold)).select("a", "b").distinct(), "neardup-pairs")
    links = stored(_confirmed(pairs, texts, threshold, words), "neardup-links")

    # buckets of three and more that are still in several components: members of different ones meet, as far as sizes and sketches allow
    labels = components(links)
    marked = stored(members.where("m > 2").join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label")), "neardup-marked")
    mixed = stored(marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket"), "neardup-mixed")
    still = stored(marked.join(mixed, "bucket"), "neardup-open")
    fine = signatures(_of(texts, stored(still.select(F.col("node").alias("id")).distinct(), "neardup-ids")), "id", "text", words, fine=True)
    still = stored(still.join(stored(fine.select(F.col("id").alias("node"), "n", "sketch", "bands"), "neardup-fine"), "node"), "neardup-open")
    u, v = still.alias("u"), still.alias("v")
    once = "array_position(zip_with(u.bands, v.bands, (x, y) -> x = y), true) = u.band + 1"  # in the first of the buckets that both are in
    met = u.join(v, (F.col("u.bucket") == F.col("v.bucket")) & (F.col("u.label") < F.col("v.label")) & _near("u", "v", threshold, FINE_WORDS, most_different(threshold, FINE_SAMPLES, FINE_WORDS, FINE_MARGIN)) & F.expr(once))
    met = met.select(F.least("u.node", "v.node").alias("a"), F.greatest("u.node", "v.node").alias("b")).distinct()
    more = stored(met.join(pairs, ["a", "b"], "left_anti"), "neardup-pairs")
    links = links.union(_confirmed(more, texts, threshold, words))

    # an id with several sets joins their nodes
    several = full.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("id")
    own = full.join(several, "id", "left_semi").join(nodes.select("fp", "node"), "fp").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    labels = components(links.union(own).distinct())
    placed = signed.select("id", "n", "fp").join(nodes.select("fp", "node"), "fp", "left").withColumn("node", F.coalesce("node", "id"))
    out = placed.join(labels, "node", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "node")).alias("component"))


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts with these ids."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """a, b of the pairs whose full sets are as similar as the threshold."""
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "neardup-ids")
    mine = stored(_of(texts, ids), "neardup-texts")
    both = pairs.join(mine.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(mine.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(released(_confirm(threshold, words)), "a long, b long").distinct()


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of docs, as they came, whose id is the smallest of their class. Of rows with one id, which are one document, one stays: that of the smallest hash of its text, then text, then hash of the whole row. Rows with a null id, and with an empty set, stay. Columns may have any names."""
    gone = classes(docs, id_col, text_col, threshold, words).where("id <> component").select("id").distinct()
    rows = whole_rows(docs, id=F.col(id_col).cast("long"), text=F.col(text_col))
    left = rows.join(gone, "id", "left_anti")
    again = stored(left.groupBy("id").agg(F.count("*").alias("m")).where("m > 1 and id is not null").select("id"), "neardup-again")
    if again.isEmpty():
        return left.select("row.*")
    first = F.struct(F.xxhash64("text"), F.col("text"), F.xxhash64(F.to_json("row")))
    one = left.join(again, "id", "left_semi").groupBy("id").agg(F.min_by("row", first).alias("row"))
    return left.join(again, "id", "left_anti").select("row.*").union(one.select("row.*"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what classes() returns; a row with a null id counts as kept."""
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
