"""Byte-level BPE, encoding and decoding by DuckDB's recursive queries in each partition.

A text is split by the vocabulary's pattern into pieces. Each piece is merged on its own, so a partition merges every
distinct piece once: its bytes become rows (piece, position, token), and a recursive query contracts, in each round, every
piece's leftmost pair of the smallest rank, found by a join with the merge table, until no pair is left. The merge
table holds each way to split a token of the vocabulary into two others. A merge whose product takes part only in
merges of higher rank is `free`: no contraction of it can make a pair that would go before the next one of the same
rank, so all that do not overlap are contracted in one round, from the left; others go one at a time. So the rounds of a
piece are bounded by the distinct ranks that it uses, and a very long piece is no worse than its merges.

Decoding joins ids with the vocabulary and concatenates the tokens' bytes in order of position, by text.

Pieces merged before are kept in a table of bounded size while a task lasts; it holds results only, so losing it costs
time and nothing else. With the task goes all of it, and the DuckDB: a worker that waits for its next task would keep both.

Nulls and the like: a null or empty text has no ids and decodes to nothing. Text that looks like a special token is
ordinary text. Rows that repeat are encoded alike. An id that the vocabulary lacks is an error in decoding. Other columns
play no part. A lone surrogate can't be in a table's text and so can't come.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released

#: Pieces that a task remembers (twice so many before it forgets), and that one recursive query takes at most; ids decoded at once.
REMEMBERED, PIECES, DECODED_IDS = 300_000, 40_000, 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, which is on every worker's Python path like the library that brings it."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """a, b, product, free: each split of a token into two."""
    left, right, product = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), product.append(rank)
    a, b, p = (np.array(x, np.int32) for x in (left, right, product))
    least = np.full(max(ranks.values()) + 1, np.iinfo(np.int32).max, np.int64)
    np.minimum.at(least, a, p)
    np.minimum.at(least, b, p)
    return pa.table({"a": a, "b": b, "product": p, "free": least[p] > p})


class Coder:
    """A vocabulary in a DuckDB of this process."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "384MB", "temp_directory": ""})
        self.db.register("given_merges", merge_table(self.ranks))
        self.db.execute("CREATE TABLE merges AS SELECT (a::BIGINT << 32) | b AS pair, product, free FROM given_merges")
        self.db.register("given_vocabulary", pa.table({"id": np.array(list(self.ranks.values()), np.int32), "token": pa.array(list(self.ranks), pa.binary())}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT id, hex(token) AS token FROM given_vocabulary")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def close(self) -> None:
        """Gives up the DuckDB and all that was remembered."""
        self.db.close()
        self.known, self.older = {}, {}

    def merge(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(x) for x in raw], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw), np.uint8)
        rows = pa.table({"piece": np.repeat(np.arange(len(raw), dtype=np.int32), sizes), "pos": (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.int32), "id": self.of_byte[data]})
        self.db.register("given_rows", rows)
        out = self.db.sql(_MERGE).to_arrow_table()
        self.db.unregister("given_rows")
        piece, ids = out.column("piece").to_numpy(), out.column("id").to_numpy().astype("<u4")
        cuts = np.searchsorted(piece, np.arange(len(raw) + 1))
        buffer = ids.tobytes()
        return [buffer[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        waiting, todo = [], {}
        for text in texts:
            pieces = self.pattern.findall(text)
            waiting.append(pieces)
            for p in set(pieces).difference(self.known):
                if p in self.older:
                    self.known[p] = self.older[p]
                else:
                    todo[p] = None
        fresh = sorted(todo, key=len)
        for at in range(0, len(fresh), PIECES):
            part = fresh[at : at + PIECES]
            self.known.update(zip(part, self.merge(part), strict=True))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in waiting]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        out: list[bytes] = [b""] * len(coded)
        at = 0
        while at < len(coded):
            to, n = at, 0
            while to < len(coded) and (to == at or n + len(coded[to]) // 4 <= DECODED_IDS):
                n += len(coded[to]) // 4
                to += 1
            sizes = np.array([len(x) // 4 for x in coded[at:to]], np.int64)
            ids = np.frombuffer(b"".join(coded[at:to]), "<u4").astype(np.int32)
            self.db.register("given_ids", pa.table({"row": np.repeat(np.arange(to - at, dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            found = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("given_ids")
            if sum(found.column("n").to_pylist()) != len(ids):
                raise ValueError("an id that the vocabulary lacks")
            for row, text in zip(found.column("row").to_pylist(), found.column("text").to_pylist(), strict=True):
                out[at + row] = bytes.fromhex(text)
            at = to
        return out


#: Rounds of contraction. pos is the first byte of a token and orders the tokens of a piece; -1 marks the second token of a pair; a piece is done when no pair is left.
_MERGE = """
WITH RECURSIVE rounds(piece, pos, id, done) AS (
    SELECT piece, pos, id, false FROM given_rows
  UNION ALL
    (WITH pairs AS (
        SELECT r.piece, r.pos, r.id, row_number() OVER w AS k, (r.id::BIGINT << 32) | lead(r.id) OVER w AS pair
        FROM rounds r WHERE NOT r.done WINDOW w AS (PARTITION BY r.piece ORDER BY r.pos)),
    met AS (SELECT p.piece, p.pos, p.id, p.k, m.product, m.free FROM pairs p LEFT JOIN merges m USING (pair)),
    best AS (SELECT piece, min(product) AS least FROM met GROUP BY piece),
    hit AS (SELECT piece, k, product, free, row_number() OVER (PARTITION BY piece ORDER BY k) AS n FROM met JOIN best USING (piece) WHERE product = least),
    nth AS (SELECT piece, k, product, free, n, row_number() OVER (PARTITION BY piece, k - n ORDER BY k) AS in_run FROM hit),
    taken AS (SELECT piece, k, product FROM nth WHERE CASE WHEN free THEN in_run % 2 = 1 ELSE n = 1 END),
    change AS (SELECT piece, k, product FROM taken UNION ALL SELECT piece, k + 1, -1 FROM taken)
    SELECT t.piece, t.pos, coalesce(x.product, t.id), b.least IS NULL
    FROM met t JOIN best b USING (piece) LEFT JOIN change x ON t.piece = x.piece AND t.k = x.k
    WHERE x.product IS DISTINCT FROM -1))
SELECT piece, id FROM rounds WHERE done ORDER BY piece, pos
"""

_DECODE = "SELECT g.row, count(v.id) AS n, coalesce(string_agg(v.token, '' ORDER BY g.pos), '') AS text FROM given_ids g LEFT JOIN vocabulary v USING (id) GROUP BY g.row"


@contextlib.contextmanager
def coder(path: str, pattern: str):
    """A task's coder of a vocabulary."""
    made = Coder(path, pattern)
    try:
        yield made
    finally:
        made.close()


def _parts(batch, size: int = 1 << 21):
    """Runs of rows with so many characters or a row more."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    pos = 0
    while pos < len(texts):
        to, n = pos, 0
        while to < len(texts) and (to == pos or n + len(texts[to]) <= size):
            n += len(texts[to])
            to += 1
        yield batch.slice(pos, to - pos), texts[pos:to]
        pos = to


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: array of the token ids, of each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        with coder(path, pattern) as c:
            for batch in batches:
                for part, texts in _parts(batch):
                    coded = c.encode(texts)
                    flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                    cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], ["id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), f"id {kind}, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """id, bytes, text of each row of what encode() returns; bytes that aren't UTF-8 read as the replacement character."""
    kind = coded.schema["id"].dataType.simpleString()

    def run(batches):
        with coder(path, pattern) as c:
            for batch in batches:
                for pos in range(0, batch.num_rows, 256):
                    part = batch.slice(pos, 256)
                    data = c.decode([np.asarray(x or [], "<u4").tobytes() for x in part.column("ids").to_pylist()])
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data])], ["id", "bytes", "text"])

    bounded_batches(coded.sparkSession)
    return coded.select("id", "ids").mapInArrow(released(run), f"id {kind}, bytes binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: each text encoded, and its ids decoded, where it lies."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        with coder(path, pattern) as c:
            for batch in batches:
                for part, texts in _parts(batch):
                    coded = c.encode(texts)
                    ids = pa.array([hashlib.sha256(x).hexdigest() for x in coded])
                    back = pa.array([hashlib.sha256(x).hexdigest() for x in c.decode(coded)])
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) // 4 for x in coded], pa.int64()), ids, back], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
