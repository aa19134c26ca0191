"""Exact top-k inner products by sorted lists without random access.

Each dimension of a block of candidates is a list sorted by value. A query reads the lists of its positive components from
the top and those of its negative ones from the bottom, all to the same depth. What is read gives each candidate a
lower and an upper bound of its score: an entry not yet read lies between the list's end and the value reached. When
the upper bound of a candidate is below the k-th best lower bound, or below the k-th best score of the blocks before, it
is out. Reading goes deeper until few are left, whose final scores are then resolved; a query for which the whole lists
were read needs nothing more. Many queries read together: the bounds of a block of queries over a block of candidates
are two matrix products of what has been read.

Queries are laid out as a table of blocks, candidates as one of chunks, both of bounded size; every block meets every chunk of vectors of
its length, spread over as many tasks as there are salts, nothing of them passes the driver, each meeting leaves k a query, and
a window over those makes the result. Products are exact: sums that 32-bit floats hold without rounding use them, larger
ones 64-bit floats or integers, and what no 64-bit integer holds is an error.

Nulls and the like: a row without id, without vector, or with a null or non-finite component takes no part. A query meets
only vectors of its own length. An empty vector scores 0. Rows that repeat an id are queries and candidates each on
their own; a query's own row, and any of the same id, is no candidate. Ties go to the smaller id. Other columns play no
part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored

#: Queries of a block and candidates of a chunk, whose bounds are held at once.
SOME_QUERIES, SOME_ROWS = 512, 8192
#: How deep the rounds read, as shares of the lists; what is left unread at most before the scores are resolved.
DEPTHS, FEW = (0.1, 0.3, 0.6, 1.0), 0.01


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v of the rows that take part."""
    whole = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def quantised(column: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of floor(scale * x)) of each length of the vectors of a column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    starts = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)]))
    return out


def exact_type(queries: np.ndarray, rows: np.ndarray):
    """A type in which all partial sums of the products are exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if most >= 2.0**62:
        raise ValueError("inner products beyond 64-bit integers")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def block_top(queries: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray, read_entries: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all that can be among the k best of the rows for each query and reach its least score. read_entries: gets the number of entries of the lists that all queries read."""
    kind = exact_type(queries, rows)
    q, v = queries.astype(kind), np.ascontiguousarray(rows.T.astype(kind))
    d, n = v.shape
    signed = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    lists = np.sort(v, axis=1)
    low, high = lists[:, :1], lists[:, -1:]
    left = np.arange(len(q))
    found = []
    before, entries = 0, 0
    for depth in DEPTHS:
        read = min(n, max(1, int(np.ceil(depth * n))))
        entries += len(left) * d * (read - before)
        before = read
        top, bottom = lists[:, n - read, None], lists[:, read - 1, None]
        upper = signed[left] @ np.concatenate([np.maximum(v, top), np.minimum(v, bottom)])
        if read == n:
            lower = upper
        else:
            lower = signed[left] @ np.concatenate([np.where(v >= top, v, low), np.where(v <= bottom, v, high)])
        best = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(left), -np.inf)
        alive = upper >= np.maximum(best, least[left])[:, None]
        counts = alive.sum(axis=1)
        done = np.ones(len(left), bool) if read == n else counts <= max(2 * k, FEW * n)
        a, b = np.nonzero(alive & done[:, None])
        if read == n:
            score = upper[a, b]
        else:
            score = np.empty(len(a), kind)
            for at in range(0, len(a), 1 << 16):
                s = slice(at, at + (1 << 16))
                score[s] = (q[left[a[s]]] * v[:, b[s]].T).sum(axis=1, dtype=np.float64 if kind != np.int64 else np.int64)
        keep = score >= least[left[a]]
        found.append((left[a][keep], b[keep], score[keep].astype(np.int64)))
        left = left[~done]
        if not len(left):
            break
    if read_entries is not None:
        read_entries.append(entries)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Best:
    """The k best (score, id) of each query so far; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id, self.size = k, np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def least(self, queries: np.ndarray) -> np.ndarray:
        return np.where(self.size[queries] == self.k, self.score[queries, -1].astype(np.float64), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(query)
        old_q = np.repeat(touched, self.size[touched])
        old = np.arange(self.k) < self.size[touched][:, None]
        q = np.concatenate([old_q, query])
        i = np.concatenate([self.id[touched][old], ids])
        s = np.concatenate([self.score[touched][old], score])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.id[q[keep], rank[keep]], self.score[q[keep], rank[keep]] = i[keep], s[keep]
        self.size[touched] = np.minimum(np.bincount(np.searchsorted(touched, q), minlength=len(touched)), self.k)


def _blocked(size: int, scale: float):
    """From id and v to rows of up to so many vectors of one length: d, ids, matrix (quantised doubles) and a number."""

    def blocked(batches):
        held: dict[int, list] = {}
        made = 0

        def out(d):
            nonlocal made
            ids, matrix = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            for at in range(0, len(ids), size):
                yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int64()), "ids": pa.array([ids[at : at + size].tobytes()], pa.binary()), "matrix": pa.array([matrix[at : at + size].tobytes()], pa.binary()), "made": pa.array([made], pa.int64())})
                made += 1

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column("id").to_numpy()
                for rows, matrix in quantised(part.column("v"), scale):
                    d = matrix.shape[1]
                    held.setdefault(d, []).append((ids[rows], matrix))
                    if sum(len(x) for x, _ in held[d]) >= size:
                        yield from out(d)
        for d in list(held):
            yield from out(d)

    return blocked


def _meet(k: int):
    """From a block of queries and a chunk of candidates to the k best of each query."""

    def meet(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                queries, rows = np.frombuffer(r["q_matrix"]).reshape(len(own), r["d"]), np.frombuffer(r["matrix"]).reshape(len(ids), r["d"])
                repeats = int(np.unique(ids, return_counts=True)[1].max())  # so many rows of a query's own id may be among the best
                best = Best(len(own), k)
                a, b, score = block_top(queries, rows, k + repeats, np.full(len(own), -np.inf))
                other = own[a] != ids[b]
                best.add(a[other], ids[b[other]], score[other])
                kept = np.arange(k) < best.size[:, None]
                q = np.repeat(np.arange(len(own)), best.size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), r["block"])), pa.array(q), pa.array(own[q]), pa.array(best.id[kept]), pa.array(best.score[kept])], ["block", "q", "query_id", "vec_id", "score"])

    return meet


def search(queries: DataFrame, candidates: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query, by the inner product of floor(scale * x)."""
    salts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    form = "d long, ids binary, matrix binary, made long"
    number = F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("made")
    # stored: a block's number must stay the same however often its task runs
    asked = stored(usable(queries, id_col, vector_col).mapInArrow(released(_blocked(SOME_QUERIES, scale)), form).withColumn("block", number), "topk-queries")
    chunks = usable(candidates, id_col, vector_col).mapInArrow(released(_blocked(SOME_ROWS, scale)), form).withColumn("salt", F.pmod(F.xxhash64(number), F.lit(salts)))
    every = asked.select("block", "d", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt"))
    met = chunks.drop("made").join(every.hint("merge"), ["d", "salt"])
    found = met.mapInArrow(released(_meet(k)), "block long, q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def twentieth(vectors: DataFrame) -> DataFrame:
    """The contract's search: rows whose vec_id is divisible by 20 against all rows."""
    return search(vectors.where(F.col("vec_id") % 20 == 0), vectors)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
