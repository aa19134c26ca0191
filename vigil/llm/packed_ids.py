"""Token ids in a binary format: an adaptive context-mixing range coder in independent, checksummed blocks.

A block holds up to BLOCK ids and nothing outside it is needed to read it; its models begin anew. Three models predict the next
id: order 2 (the last id seen after the same two ids), order 1 (the last seen after the same one) and order 0 (adaptive
counts of every id met; an id not met is an escape and 16 plain bits). Orders 2 and 1 keep a confidence for each context, which
rises with each success. How much of the whole each order gets is learned for each pair of confidences from the block itself.
One step of a range coder, with carries, codes an id.

A block's ids are dealt to lanes, consecutive parts of equal length. All lanes of a block share its models, each has a coder
of its own, and all step together as numpy arrays: the models learn from every lane at once, so short lanes cost little.

A block is magic, number of ids, lanes and 32-bit words, CRC-32 of all that and the words, CRC-32 of the ids, then the words of each
lane by number and the words; all little-endian. A segment is whole documents' blocks end to end, with their ids and
lengths. Segments are rows of a Parquet table, in ascending order of id over the files, so that any store that Spark
writes will do, a task that is lost leaves nothing half-written, and segments are read in any order: each holds the number of
ids before it in its file.

Texts are cut at ASCII white space, which the tokenizer never joins; each distinct piece is tokenized once in a worker while
it is remembered. Pieces of Latin letters, digits and ASCII signs are parted by the tokenizer's pattern here and merged by
the tiktoken library over the same ranks, the end of a word being a byte that these pieces don't have; that gives the tokenizers library's
ids (each token's own text merges to it, and so no other pair can make it: checked once, in `ranks`). All others go
to the tokenizers library.

Nulls and the like: a null or empty text is the end id alone. A null id comes first. Rows that repeat an id stand next to
each other, each on its own. A very long text is one segment of many blocks. Ids from 0 to 65535 can be coded; a damaged
block raises an error. Other columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored

#: Ids of a block; lanes of a block at most, and ids of a lane at least where there are so many; ids between two refreshes of the counts at most.
BLOCK, LANES, LANE_IDS, REFRESH = 1 << 23, 8192, 512, 1 << 17
#: Ids of a segment, about; pieces of text that a worker remembers (twice so many before it forgets).
SEGMENT, REMEMBERED = 1 << 22, 400_000
MAGIC = b"CMR2"
_HEAD = struct.Struct("<4sIIIII")
_U = np.uint64
_WHOLE = 24  # bits of the whole that the orders share
_ORDER0 = 17  # bits of the whole of the order-0 counts
_CONTEXTS = 19  # bits of the number of contexts of order 2
_ESCAPE = 1 << 16
_LEAST, _WORD = _U(1 << 32), _U(32)
#: The confidence after a miss (first 16) and after a success.
_NEXT = np.array([s >> 1 for s in range(16)] + [min(15, s + 1 if s else 2) for s in range(16)], np.int32)


class Model:
    """The models of a block, shared by its lanes."""

    def __init__(self, lanes: int):
        self.lanes, self.steps = lanes, 0
        self.after1, self.after2 = np.zeros(1 << 16, np.int32), np.zeros(1 << _CONTEXTS, np.int32)  # id << 4 | confidence
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.counts = np.zeros(1 << 16, np.int64)
        # by (whether they agree, confidence 2, confidence 1): how often order 2, order 1, neither was right
        self.right = np.full((512, 4), 0.05)
        self.right[:, 2] = 0.4
        self.ids, self.met = [], []
        self.escapes, self.seen_since = 1, 1
        self.refresh()

    def refresh(self) -> None:
        """Brings the counts and the orders' shares up to date with the steps since the last time."""
        if self.ids:
            self.counts += np.bincount(np.concatenate(self.ids), minlength=1 << 16)
            self.right += np.bincount(np.concatenate(self.met), minlength=2048).reshape(512, 4)
        p = self.right[:, :3] / self.right[:, :3].sum(axis=1, keepdims=True)
        unit = np.clip(np.rint(p[:, 2] * (1 << _WHOLE - _ORDER0)), 1, (1 << _WHOLE - _ORDER0) - 1).astype(np.int64)
        rest = (1 << _WHOLE) - (unit << _ORDER0)
        self.shares = np.clip(rest * (p[:, 0] / (p[:, 0] + p[:, 1])), 256, rest - 256).astype(np.int64) << 8 | unit
        met = np.flatnonzero(self.counts)
        whole = 1 << _ORDER0
        escape = whole if not len(met) else min(whole // 4, max(8, whole * self.escapes // self.seen_since))
        own = 1 + self.counts[met] * (whole - escape - len(met)) // max(1, self.counts.sum())
        used = int(own.sum())
        self.order0 = np.full(_ESCAPE + 1, used << 20 | whole - used, np.int64)  # what is below << 20 | the id's own; an id not met: the escape's
        self.order0[met] = np.cumsum(own) - own << 20 | own
        self.table = np.full(whole, _ESCAPE, np.int32)
        self.table[:used] = np.repeat(met, own)
        self.unmet = self.counts == 0
        self.ids, self.met, self.escapes, self.seen_since = [], [], 1, 2
        self.next = self.steps + max(1, min(self.steps // 4, REFRESH // self.lanes))

    def predict(self) -> None:
        """The predictions of the next id of each lane and what the orders get: [0, a) is order 2's, [a, b) order 1's, then come u times order 0's counts."""
        at = self.one << 16
        at |= self.two
        at *= 0x9E3779B1
        at &= 0xFFFFFFFF
        at >>= 32 - _CONTEXTS
        self.at2 = at
        g1, g2 = self.after1[self.one], self.after2[at]
        self.c1, self.c2 = g1 >> 4, g2 >> 4
        self.s1, self.s2 = g1 & 15, g2 & 15
        self.context = (self.c1 == self.c2) * np.int32(256)
        self.context |= self.s2 << 4
        self.context |= self.s1
        share = self.shares[self.context]
        self.u = share & 255
        self.a = share >> 8
        self.b = (1 << _WHOLE) - (self.u << _ORDER0)

    def learn(self, ids, small, is2, other) -> None:
        """ids, and as 32 bits, of each lane; is2, other: whether order 2's share coded it, and whether neither order 2's nor order 1's did."""
        new = small << 4
        self.after2[self.at2] = new | _NEXT[self.s2 | is2 * np.int32(16)]
        self.after1[self.one] = new | _NEXT[self.s1 | (self.c1 == small) * np.int32(16)]
        self.two, self.one = self.one, ids
        self.ids.append(small)
        met = self.context << 2
        met += 1
        met -= is2
        met += other
        self.met.append(met)
        self.steps += 1
        self.seen_since += len(ids)
        if self.steps >= self.next:
            self.refresh()


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // LANE_IDS))


def _code(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each lane, the words) of a block's ids."""
    lanes = _lanes(len(ids))
    steps = -(-len(ids) // lanes)
    columns = np.zeros(lanes * steps, np.uint16)
    columns[: len(ids)] = ids
    columns = np.ascontiguousarray(columns.reshape(lanes, steps).T)
    model = Model(lanes)
    low, size = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    width = steps * 5 // 4 + 8
    words, pos = np.zeros(lanes * width, np.uint32), np.arange(lanes) * width

    def carry(over, where):
        at = where[np.flatnonzero(over)] - 1
        while len(at):
            words[at] += np.uint32(1)
            at = at[words[at] == 0] - 1

    def shift(low, size, pos):
        need = np.flatnonzero(size < _LEAST)
        if len(need):
            l, p = low[need], pos[need]
            words[p] = (l >> _WORD).astype(np.uint32)
            low[need], pos[need] = l << _WORD, p + 1
            size[need] <<= _WORD

    for t in range(steps):
        small = columns[t].astype(np.int32)
        x = small.astype(np.int64)
        model.predict()
        is2 = small == model.c2
        other = (small != model.c1) & ~is2
        order0 = model.order0[x]
        start = order0 >> 20
        start *= model.u
        start += model.b
        own = (order0 & 0xFFFFF) * model.u
        near = np.flatnonzero(~other)  # what orders 2 and 1 code
        if len(near):
            two, a = is2[near], model.a[near]
            start[near] = a * ~two
            own[near] = np.where(two, a, model.b[near] - a)
        size >>= _U(_WHOLE)
        new = low + size * start.view(_U)
        over = new < low
        if over.any():
            carry(over, pos)
        low = new
        size *= own.view(_U)
        shift(low, size, pos)
        escaped = model.unmet[x] & other
        if escaped.any():
            at = np.flatnonzero(escaped)
            l, s, p = low[at], size[at] >> _U(16), pos[at]
            new = l + s * x[at].astype(_U)
            carry(new < l, p)
            shift(new, s, p)
            low[at], size[at], pos[at] = new, s, p
            model.escapes += len(at)
        model.learn(x, small, is2, other)
    last = (low >> _WORD).astype(np.uint32) + np.uint32(1)  # a word that lies in the interval, whatever follows
    carry(last == 0, pos)
    words[pos] = last
    sizes = pos + 1 - np.arange(lanes) * width
    return sizes.astype("<u4"), words.reshape(lanes, width)[np.arange(width) < sizes[:, None]].astype("<u4")


def _uncode(sizes: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    lanes = len(sizes)
    steps = -(-n // lanes)
    pos = np.cumsum(sizes.astype(np.int64)) - sizes
    end = pos + sizes
    words = np.concatenate([words, np.zeros(1, "<u4")]).astype(_U)
    nothing = len(words) - 1  # what is read beyond a lane's words
    read = lambda p, e: words[np.where(p < e, p, nothing)]
    code = read(pos, end) << _WORD
    code |= read(pos + 1, end)
    pos += 2
    size = np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    model = Model(lanes)
    out = np.empty((steps, lanes), np.uint16)
    most = _U((1 << _WHOLE) - 1)

    def shift(code, size, pos, end):
        need = np.flatnonzero(size < _LEAST)
        if len(need):
            p = pos[need]
            code[need] = code[need] << _WORD | read(p, end[need])
            pos[need] = p + 1
            size[need] <<= _WORD

    for t in range(steps):
        model.predict()
        size >>= _U(_WHOLE)
        v = np.minimum(code // size, most).astype(np.int64)
        is2 = v < model.a
        v -= model.b
        other = v >= 0
        v *= other
        small = model.table[(v / model.u).astype(np.int64)]  # the whole part is exact: both are small
        x = small.astype(np.int64)
        order0 = model.order0[x]
        start = order0 >> 20
        start *= model.u
        start += model.b
        own = (order0 & 0xFFFFF) * model.u
        near = np.flatnonzero(~other)
        if len(near):
            two, a = is2[near], model.a[near]
            start[near] = a * ~two
            own[near] = np.where(two, a, model.b[near] - a)
            small[near] = found = np.where(two, model.c2[near], model.c1[near])
            x[near] = found
        code -= size * start.view(_U)
        size *= own.view(_U)
        shift(code, size, pos, end)
        escaped = small == _ESCAPE
        if escaped.any():
            at = np.flatnonzero(escaped)
            c, s, p = code[at], size[at] >> _U(16), pos[at]
            plain = np.minimum(c // s, _U(0xFFFF))
            c -= s * plain
            shift(c, s, p, end[at])
            code[at], size[at], pos[at] = c, s, p
            x[at] = plain.astype(np.int64)
            small[at] = x[at]
            model.escapes += len(at)
        model.learn(x, small, is2, other)
        out[t] = small
    return np.ascontiguousarray(out.T).ravel()[:n]


def pack(ids: np.ndarray) -> bytes:
    """The blocks of a sequence of ids, end to end."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) > 0xFFFF):
        raise ValueError("an id beyond 16 bits")
    out = []
    for at in range(0, len(ids), BLOCK):
        own = ids[at : at + BLOCK]
        sizes, words = _code(own)
        data = sizes.tobytes() + words.tobytes()
        head = (MAGIC, len(own), len(sizes), len(words))
        out += [_HEAD.pack(*head, zlib.crc32(data, zlib.crc32(repr(head[1:]).encode())), zlib.crc32(own.astype("<u2").tobytes())), data]
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    """The ids of blocks end to end."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise ValueError("a block is cut off")
        magic, n, lanes, many, crc, own = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        size = 4 * (lanes + many)
        if magic != MAGIC or len(data) - at < size or zlib.crc32(data[at : at + size], zlib.crc32(repr((n, lanes, many)).encode())) != crc:
            raise ValueError("a block is damaged")
        ids = _uncode(np.frombuffer(data, "<u4", lanes, at), np.frombuffer(data, "<u4", many, at + 4 * lanes), n)
        if zlib.crc32(ids.astype("<u2").tobytes()) != own:
            raise ValueError("a block is damaged")
        out.append(ids)
        at += size
    return np.concatenate(out) if out else np.zeros(0, "<u2")


def unpack_all(segments: list[bytes]) -> list[np.ndarray]:
    """The ids of each sequence of blocks."""
    return [unpack(data) for data in segments]


# ---- ids of texts ----

_state: dict = {}
#: The byte that ends a word.
END = b"\x01"


def ranks(path: str) -> dict[bytes, int] | None:
    """The ranks of the bytes of each token of a byte-level vocabulary with word ends, the end being the byte END; None where the tokenizer's steps are others, the merges aren't in the order of the ids, or a token's own text doesn't merge to it."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    model = form["model"]
    kinds = [n["type"] for n in (form["normalizer"] or {}).get("normalizers", [])]
    split = ((form["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
    if kinds != ["NFC", "Replace", "Lowercase"] or split != Tokens.PATTERN:
        return None
    vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    letters = sorted(ByteLevel.alphabet())
    plain = [b for b in range(256) if chr(b) in letters]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    end = model.get("end_of_word_suffix") or ""
    first = 2 * len(byte_of)
    own = Tokenizer.from_file(path).model
    out = {}
    for i, (a, b) in enumerate([(x, "") for x in byte_of] + [(x, end) for x in byte_of] + merges):
        text = a + b
        rank = vocabulary.get(text)
        is_end = bool(end) and text.endswith(end)
        stem = text[: len(text) - len(end)] if is_end else text
        if rank is None or any(c not in byte_of for c in stem) or (rank != i if i >= first else rank >= first or (rank >= first // 2) != is_end):
            return None
        if i >= first and is_end and [t.id for t in own.tokenize(stem)] != [rank]:
            return None
        if i >= first and not is_end and _merged(stem, merges, vocabulary) != [rank]:
            return None
        if out.setdefault(bytes(byte_of[c] for c in stem) + (END if is_end else b""), rank) != rank:
            return None
    return out


_merge_of: dict = {}


def _merged(text: str, merges: list, vocabulary: dict) -> list[int]:
    """The ids of a text without a word's end, by the merges alone."""
    if _merge_of.get("of") is not merges:
        _merge_of.update(of=merges, rank={(a, b): i for i, (a, b) in enumerate(merges)})
    rank, parts = _merge_of["rank"], list(text)
    while len(parts) > 1:
        at = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 40))
        if (parts[at], parts[at + 1]) not in rank:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [vocabulary[p] for p in parts]


class Tokens:
    """A tokenizer of the tokenizers library that drops white space, with the pieces that it met before. found: what ranks() gave for its file."""

    #: The tokenizer's pattern; below, the same on text in lower case without what is in OTHER.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u017f]+")
    #: What a piece must not have to be parted here: white space and marks of this module, what may begin a special token, and all but letters of one code point whose lower case is one too.
    OTHER = re.compile("[^\x03-\x08\x0e-\x1b\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]|<\\|")

    def __init__(self, path: str, found: dict[bytes, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.merge = None
        if found:
            import tiktoken

            self.merge = tiktoken.Encoding("words", pat_str=r"[^\x01\n]+\x01", mergeable_ranks=found, special_tokens={})._core_bpe.encode_ordinary
            self.ends = np.zeros(1 << 16, bool)
            self.ends[[i for token, i in found.items() if len(token) > 1 and token.endswith(END)]] = True

    def _learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces not met before, as little-endian unsigned 16-bit integers."""
        others = pieces
        if self.merge:
            bad = self.OTHER.search
            others = [p for p in pieces if bad(p)]
            if len(others) < len(pieces):
                self._merge([p for p in pieces if not bad(p)] if others else pieces)
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.known[p] = array("H", e.ids).tobytes()  # an id beyond 16 bits is an OverflowError

    def _merge(self, pieces: list[str]) -> None:
        marked = self.PARTS.sub("\\g<0>\x01", "\n".join(pieces).lower() + "\n")
        ids = np.array(self.merge(marked), "<u2")
        data = np.frombuffer(marked.encode(), np.uint8)
        words = np.cumsum(data == 1)[data == 10]  # of all pieces so far
        cuts = (2 * np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[words]).tolist()
        coded = ids.tobytes()
        self.known.update(zip(pieces, [coded[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))

    def encode(self, texts: list[str] | pa.Array, end: int) -> list[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 16-bit integers."""
        ids, lengths = self.encode_all(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, end)
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, each with the end id, end to end; the number of each)."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        pieces = split.flatten().dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        coded = list(map(self.known.get, names))
        absent = [i for i, c in enumerate(coded) if c is None]
        if absent:
            todo = []
            for p in map(names.__getitem__, absent):
                if p in self.older:
                    self.known[p] = self.older[p]
                else:
                    todo.append(p)
            self._learn(todo)
            for i in absent:
                coded[i] = self.known[names[i]]
        coded.append(struct.pack("<H", end))
        flat = np.frombuffer(b"".join(coded), "<u2")
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        first = np.cumsum(size) - size
        offsets = split.offsets.to_numpy().astype(np.int64)
        which = np.insert(pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets[1:] - offsets[0], len(names))
        many = size[which]
        before = np.cumsum(many) - many
        ids = flat[np.repeat(first[which] - before, many) + np.arange(int(many.sum()))]
        text_first = np.append(before, many.sum())[(offsets - offsets[0]) + np.arange(len(offsets))]
        return ids, np.diff(text_first)


def tokens(path: str, found: dict[bytes, int] | None) -> Tokens:
    """This process's tokenizer of a file."""
    if path not in _state:
        _state[path] = Tokens(path, found)
    return _state[path]


# ---- tables ----

FORM = "file int, segment int, first long, n long, doc_ids array<{kind}>, lengths array<long>, data binary"


def _pieces(batches, size: int = 8 << 20):
    """The rows in batches of about so many bytes of text, or a row more."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            bytes_of = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).slice(at).to_numpy(zero_copy_only=False).astype(np.int64))
            to = at + max(1, int(np.searchsorted(bytes_of, size - n, "right")))
            held.append(batch.slice(at, to - at))
            n += int(bytes_of[min(to - at, len(bytes_of)) - 1])
            at = to
            if n >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write(docs: DataFrame, tokenizer_path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Writes the ids of docs in ascending order of id and returns the table of segments. partitions: files."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    placed = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text", F.spark_partition_id().alias("file"))

    shared = spark.sparkContext.broadcast(ranks(tokenizer_path))  # as large as the vocabulary

    def segments(batches):
        own, held, size, first, number = [], [], 0, 0, 0

        def made(file):
            ids, lengths = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            return pa.RecordBatch.from_pydict({
                "file": pa.array([file], pa.int32()), "segment": pa.array([number], pa.int32()), "first": pa.array([first], pa.int64()), "n": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([pa.chunked_array(own).to_pylist()], pa.list_(own[0].type)), "lengths": pa.array([lengths], pa.list_(pa.int64())), "data": pa.array([pack(ids)], pa.binary()),
            })

        for part in _pieces(batches):
            file = part.column("file")[0].as_py()
            own.append(part.column("id"))
            held.append(tokens(tokenizer_path, shared.value).encode_all(part.column("text"), end))
            size += len(held[-1][0])
            if size >= SEGMENT:
                yield made(file)
                first, number, own, held, size = first + size, number + 1, [], [], 0
        if held:
            yield made(file)

    return stored(placed.mapInArrow(released(segments), FORM.format(kind=kind)), "packed-ids")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document of the files that write() has made."""
    return _read(files, "ids array<int>", lambda ids: (pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),))


def digest(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files that write() has made."""
    return _read(files, "ids_crc32 long", lambda ids: (pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),))


def _read(files: DataFrame, form: str, made) -> DataFrame:
    spark = files.sparkSession
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = {r["file"]: r["n"] for r in files.groupBy("file").agg(F.sum("n").alias("n")).collect()}  # a number a file
    before, total = {}, 0
    for file in sorted(sizes):
        before[file], total = total, total + sizes[file]
    shared = spark.sparkContext.broadcast(before)
    names = ["doc_id", "start", "n_tokens", form.split(" ")[0]]

    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = unpack(batch.column("data")[row].as_py())
                lengths = batch.column("lengths")[row].values.to_numpy()
                start = np.cumsum(lengths) - lengths
                if len(ids) != lengths.sum():
                    raise ValueError("a segment is cut off")
                base = shared.value[batch.column("file")[row].as_py()] + batch.column("first")[row].as_py()
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[row].values, pa.array(base + start), pa.array(lengths), *made([ids[a : a + n] for a, n in zip(start, lengths, strict=True)])], names)

    return files.select("file", "first", "doc_ids", "lengths", "data").mapInArrow(released(documents), f"doc_id {kind}, start long, n_tokens long, {form}")
