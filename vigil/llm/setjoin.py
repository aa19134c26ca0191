"""Jaccard join of word-shingle sets with signature trees.

Two documents are linked if their sets' intersection is such a share of their union. The join is exact: nothing is sampled.

1. Prefixes. Of a set of n shingles, in an order that all sets share, the first n - ceil(t n) + 1 hold one of the first ones of
   every set that it is linked with. The order is by how many documents a shingle is in, rare ones first, counted in a table of fixed size; any
   order is right, this one keeps common lines out of the prefixes. Documents of equal sets are one node; nodes that share a prefix shingle are a group;
   groups of the same members are one group.
2. Stars. Each member of a group meets the group's leader, the member that meets others most often; pairs whose bitmaps allow the threshold are confirmed. Links give components.
3. Signature trees, for groups that still lie in several components. A leaf is a set: its size and the bitmap that its shingles are hashed into, of four bits a shingle or more. An inner
   node holds its children's bitmaps combined by OR, the range of their sizes, the most shingles that share a bit with others, and the range of their
   components. Two trees (or one with itself) are walked from the roots down, pair of nodes by pair of nodes: a pair is left where sizes don't allow
   the threshold, where both lie in one component, or where the most that any two sets below can have in common, the bits that both have
   and the shingles beyond one a bit, is too little. Groups are cut into blocks of BLOCK members, those of a large component apart, and
   blocks that may hold a link meet, each meeting in a task of its own.
4. What is left is confirmed on the full sets.

All pairs of an unlinked group meet at the root only. No partners or candidates are capped, and no group is in one task.

Nulls and the like: a text that is null, empty or blank has an empty set and is linked with nothing. A text with fewer words than a shingle is
one shingle, its whole sequence. Rows that repeat an id are one document with several texts: all of their links count. A row with
a null id is linked with nothing and has a null component. Ties: the smallest id. Very long texts are taken whole; shingles are told apart by 64-bit hashes.
Other columns play no part. An empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released, stored
from .neardup import _confirmed, components, mix64, shingle_sets

#: Counters of the shared order.
COUNTERS = 1 << 18
#: Bits of a bitmap at least and at most; the ratio of a band's sizes.
LEAST_BITS, MOST_BITS, BAND = 256, 1 << 17, 1.25
#: Members of a block, children of a node, pairs of nodes looked at in one go.
BLOCK, FAN, PAIRS = 1024, 2, 1 << 14
#: Up to so many sets that come again, their prints (16 bytes) are broadcast; beyond, a join serves.
BROADCAST_SETS = 500_000


def bitmap(found: np.ndarray) -> bytes:
    """The bitmap of a set of hashes, a power of two of bits, four a hash at least."""
    bits = min(max(1 << (4 * len(found) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    at = np.zeros(bits, np.uint8)
    at[(found >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(at, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap as words, brought to a smaller width (in bytes)."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(len(bits) // width, -1), axis=0)


def prefix_length(n: int, hundredths: int) -> int:
    return n - -(-hundredths * n // 100) + 1


def frequencies(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """How many sets have a shingle that falls on each counter, on a logarithmic scale of 16 bits: COUNTERS numbers, whatever the input."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for found in shingle_sets(batch.column(0), words):
                at = (found >> np.uint64(46)).astype(np.int64)
                total += np.bincount(at, minlength=COUNTERS) if len(at) > COUNTERS // 8 else 0
                if len(at) <= COUNTERS // 8:
                    np.add.at(total, at, 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 15):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 15)].astype(np.int32)), pa.array(total[at[i : i + (1 << 15)]])], ["counter", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(released(count), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, np.uint16)
    out[rows.column("counter").to_numpy()] = np.minimum(np.round(256 * np.log2(1.0 + rows.column("n").to_numpy())), 65535).astype(np.uint16)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, hundredths: int, order: np.ndarray) -> DataFrame:
    """id, n, fp (of the set; null if empty), bits, prefix (hashes) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # of fixed size

    def sign(batches):
        frequent = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, prints, bits, prefixes = [], [], [], []
                for found in shingle_sets(part.column(1), words):
                    sizes.append(len(found))
                    if not len(found):
                        prints.append(None), bits.append(None), prefixes.append(None)
                        continue
                    prints.append(np.bitwise_xor.reduce(mix64(found)).tobytes() + np.add.reduce(mix64(found + np.uint64(0x632BE59BD9B4E019))).tobytes())
                    bits.append(bitmap(found))
                    rare = np.argsort(frequent[(found >> np.uint64(46)).astype(np.int64)], kind="stable")  # of equal counts the smaller hash
                    prefixes.append(found[rare[: prefix_length(len(found), hundredths)]].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["id", "n", "fp", "bits", "prefix"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(released(sign), "id long, n long, fp binary, bits binary, prefix array<bigint>")


def _allowed(hundredths: int):
    """From pairs (a, b, their sizes n, m and bitmaps x, y) to the (a, b) whose sizes and bitmaps allow the threshold."""

    def allow(batches):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            like = (n * hundredths <= m * 100) & (m * hundredths <= n * 100)
            keep = np.zeros(len(n), bool)
            xs, ys = batch.column("x"), batch.column("y")
            for i in np.flatnonzero(like):
                x, y = xs[i].as_py(), ys[i].as_py()
                width = min(len(x), len(y))
                x, y = folded(x, width), folded(y, width)
                more = min(n[i] - int(np.bitwise_count(x).sum()), m[i] - int(np.bitwise_count(y).sum()))
                keep[i] = (int(np.bitwise_count(x & y).sum()) + more) * (100 + hundredths) >= hundredths * (n[i] + m[i])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return allow


# ---- trees ----


class Tree:
    """Levels from the leaves up. Of each node: bits (OR of those below), lo and hi (sizes), beyond (the most shingles of a set beyond one a bit), first and last (components)."""

    def __init__(self, nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        by = np.lexsort((sizes, labels))  # a component's members lie together, then those of like sizes
        self.nodes, sizes, bits, labels = nodes[by], sizes[by], bits[by], labels[by]
        beyond = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, beyond, labels, labels)]
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, beyond, first, last = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(beyond, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))


def _may(x, i, y, j, hundredths: int) -> np.ndarray:
    """Of each pair of nodes, whether a set of one and a set of the other, of different components, may be as similar as the threshold."""
    bx, lx, hx, ex, fx, zx = (c[i] for c in x)
    by, ly, hy, ey, fy, zy = (c[j] for c in y)
    apart = ~((fx == zx) & (fy == zy) & (fx == fy))
    # the least sizes that a pair within the threshold can have
    n, m = np.maximum(lx, -(-hundredths * ly // 100)), np.maximum(ly, -(-hundredths * lx // 100))
    common = np.minimum(np.bitwise_count(bx & by).sum(axis=1, dtype=np.int64) + np.minimum(ex, ey), np.minimum(hx, hy))
    return apart & (n <= hx) & (m <= hy) & (common * (100 + hundredths) >= hundredths * (n + m))


def walk(a: Tree, b: Tree, hundredths: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(nodes of a, nodes of b, pairs of tree nodes looked at) that may be linked; a tree with itself: each pair once."""
    same = a is b
    found_a, found_b, looked = [], [], 0
    todo = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        p, q, i, j = todo.pop()
        if len(i) > PAIRS:
            todo += [(p, q, i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]
            continue
        looked += len(i)
        held = _may(a.levels[p], i, b.levels[q], j, hundredths)
        i, j = i[held], j[held]
        if not len(i):
            continue
        if p == q == 0:
            found_a.append(a.nodes[i]), found_b.append(b.nodes[j])
            continue
        # the taller one's nodes, or both, give way to their children
        down_a, down_b = p >= q, q >= p
        child = np.arange(FAN)
        if down_a:
            i, j = (i[:, None] * FAN + child).ravel(), np.repeat(j, FAN)
            p -= 1
            ok = i < len(a.nodes if p == 0 else a.levels[p][1])
            i, j = i[ok], j[ok]
        if down_b:
            i, j = np.repeat(i, FAN), (j[:, None] * FAN + child).ravel()
            q -= 1
            ok = j < len(b.levels[q][1])
            i, j = i[ok], j[ok]
        if same:
            ok = (i < j) if p == 0 else (i <= j)
            i, j = i[ok], j[ok]
        todo.append((p, q, i, j))
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a) if found_a else none), (np.concatenate(found_b) if found_b else none), looked


def _meetings(hundredths: int):
    """From rows sorted by meeting (grp, x, y), side by side, to the (a, b) that may be linked. A meeting of a block with itself is one tree, of two blocks two."""

    def grown(rows: pa.Table, width: int) -> Tree:
        bits = np.array([folded(x, width) for x in rows.column("bits").to_pylist()])
        return Tree(*(rows.column(c).to_numpy() for c in ("node", "label", "n")), bits)

    def met(rows: pa.Table):
        side, width = rows.column("side").to_numpy(), pc.min(pc.binary_length(rows.column("bits"))).as_py()
        if rows.column("x")[0].as_py() == rows.column("y")[0].as_py():
            a = b = grown(rows, width)
        elif side.all() or not side.any():
            return None
        else:
            a, b = grown(rows.filter(pa.array(side == 0)), width), grown(rows.filter(pa.array(side == 1)), width)
        i, j, _ = walk(a, b, hundredths)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"]) if len(i) else None

    def meet(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in ("grp", "x", "y")]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            cuts = [0, *new.tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in ("grp", "x", "y")):
                    if (out := met(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(part)
        if held and (out := met(pa.Table.from_batches(held))) is not None:
            yield out

    return meet


def meetings(members: DataFrame) -> DataFrame:
    """grp, x, y, side and the other columns: members (grp, label, node, ...) dealt into blocks, a row for each meeting of a block that may hold a link.

    The members of a component that would fill half a block have blocks of their own, which don't meet each other; the rest are dealt by component.
    """
    parts = members.groupBy("grp", "label").agg(F.count("*").alias("c"))
    own = F.col("c") >= BLOCK // 2
    parts = parts.withColumns({"own": own, "cuts": F.ceil(F.col("c") / BLOCK)})
    rest = parts.groupBy("grp").agg(F.ceil(F.coalesce(F.sum(F.when(~F.col("own"), F.col("c"))), F.lit(0)) / BLOCK).alias("shared"))
    parts = parts.join(rest, "grp")
    # a block: its component (or null) and number
    blocks = parts.select("grp", "label", F.when(F.col("own"), F.col("label")).alias("of"), "cuts", "shared", "own")
    listed = blocks.select("grp", "of", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.sequence(F.lit(0), F.greatest(F.col("shared"), F.lit(1)) - 1))).alias("k")).distinct()
    listed = listed.select("grp", "of", "k", F.xxhash64("of", "k").alias("block"))
    u, v = listed.alias("u"), listed.alias("v")
    # blocks of one group, which are its members / BLOCK
    pairs = u.join(v, F.col("u.grp") == F.col("v.grp")).where((F.col("u.block") <= F.col("v.block")) & F.when(F.col("u.of").isNotNull() & F.col("v.of").isNotNull(), F.col("u.of") != F.col("v.of")).otherwise(True))
    pairs = pairs.select(F.col("u.grp").alias("grp"), F.col("u.block").alias("x"), F.col("v.block").alias("y"))
    sides = pairs.select("grp", "x", "y", F.col("x").alias("block"), F.lit(0).alias("side")).union(pairs.where("x <> y").select("grp", "x", "y", F.col("y").alias("block"), F.lit(1).alias("side")))
    placed = members.join(blocks, ["grp", "label"])
    number = F.when(F.col("own"), F.pmod(F.xxhash64("node"), F.col("cuts"))).otherwise(F.pmod(F.xxhash64("label"), F.greatest(F.col("shared"), F.lit(1))))
    placed = placed.withColumn("block", F.xxhash64("of", number.cast("bigint").alias("k"))).drop("of", "cuts", "shared", "own")
    return placed.join(sides, ["grp", "block"]).drop("block")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, words: int = 3) -> DataFrame:
    """Per row of docs: id, n_shingles, component (smallest id reachable by links)."""
    hundredths = round(threshold * 100)
    bounded_batches(docs.sparkSession)
    signed = stored(signatures(docs, id_col, text_col, words, hundredths, frequencies(docs, text_col, words)), "setjoin-signatures")
    full = signed.where("id is not null and fp is not null")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # a node for each distinct set: the smallest id that has it. Only rows whose set comes again are brought together
    again = stored(full.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"), "setjoin-again")
    again = F.broadcast(again) if again.count() <= BROADCAST_SETS else again
    columns = ("n", "bits", "prefix")
    copies = full.join(again, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("node"), *(F.first(c).alias(c) for c in columns))
    nodes = stored(full.join(again, "fp", "left_anti").select("fp", F.col("id").alias("node"), *columns).unionByName(copies), "setjoin-nodes")

    # groups of nodes of like sizes that share a shingle of their prefixes, each set of members once
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")
    bands = F.sequence(band(F.col("n")), band(F.floor(F.col("n") * 100 / hundredths)))  # its own, and those of the larger sets that it may be linked with
    keys = nodes.select("node", "prefix", F.explode(bands).alias("band")).select("node", "band", F.explode("prefix").alias("h")).select("node", F.shiftrightunsigned(F.xxhash64("h", "band"), 16).alias("grp"))  # 48 bits, which the exchange carries; groups that fall together only meet in vain
    shared = keys.groupBy("grp").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(keys.join(shared, "grp"), "setjoin-shared")
    # most groups are a pair, which needs no leader
    two = members.where("m = 2").groupBy("grp").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    members = members.where("m > 2")
    same = members.groupBy("grp", "m").agg(F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("t"))
    groups = stored(same.groupBy("m", "s", "t").agg(F.min("grp").alias("grp")).select("grp"), "setjoin-groups")
    members = stored(members.join(groups, "grp").select("grp", "node", "m"), "setjoin-members")
    met_by = stored(members.groupBy("node").agg((F.sum("m") * 65536 + F.pmod(F.xxhash64("node"), F.lit(65536))).alias("meets")), "setjoin-meets")
    lead = stored(members.join(met_by, "node").groupBy("grp").agg(F.max_by("node", "meets").alias("lead")), "setjoin-lead")

    # stars
    first = members.join(lead, "grp").where("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).union(two).distinct()
    info = nodes.select("node", "n", "bits")
    first = first.join(info.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b").join(info.select(F.col("node").alias("a"), "n", F.col("bits").alias("x")), "a")
    pairs = stored(first.select("a", "b", "n", "m", "x", "y").mapInArrow(released(_allowed(hundredths)), "a long, b long").distinct(), "setjoin-pairs")
    links = stored(_confirmed(pairs, texts, threshold, words), "setjoin-links")

    # trees; of an id with several texts each set is a leaf of its node
    labels = components(links)
    marked = stored(members.join(labels, "node", "left").select("grp", "node", F.coalesce("label", "node").alias("label")), "setjoin-marked")
    mixed = stored(marked.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("grp"), "setjoin-mixed")
    still = stored(marked.join(mixed, "grp"), "setjoin-open")
    dealt = meetings(still).join(info, "node").select("grp", "x", "y", "side", "node", "label", "n", "bits")
    dealt = dealt.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
    met = stored(dealt.mapInArrow(released(_meetings(hundredths)), "a long, b long").where("a <> b").distinct(), "setjoin-met")
    links = links.union(_confirmed(stored(met.join(pairs, ["a", "b"], "left_anti"), "setjoin-pairs"), texts, threshold, words))

    # an id with several sets joins their nodes
    several = full.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("id")
    own = full.join(several, "id", "left_semi").join(nodes.select("fp", "node"), "fp").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    labels = components(links.union(own).distinct())
    placed = signed.select("id", "n", "fp").join(nodes.select("fp", "node"), "fp", "left").withColumn("node", F.coalesce("node", "id"))
    out = placed.join(labels, "node", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "node")).alias("component"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what classes() returns."""
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


#: The same by all shingles that two documents have in common.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS sh FROM w),
f AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS fp, sh FROM s), g AS (SELECT fp, min(doc_id) AS node, any_value(n) AS n, any_value(sh) AS sh FROM f WHERE n > 0 GROUP BY fp),
k AS (SELECT node, n, unnest(sh) AS h FROM g), c AS (SELECT a.node AS a, b.node AS b FROM k a JOIN k b ON a.h = b.h AND a.node < b.node AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM c UNION SELECT b, a FROM c), r(node, other) AS (SELECT node, node FROM g UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other), p AS (SELECT node, min(other) AS component FROM r GROUP BY 1)
SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_shingles, coalesce(p.component, f.doc_id) AS component_id FROM f LEFT JOIN g ON f.fp = g.fp AND f.n > 0 LEFT JOIN p ON p.node = g.node"""
