"""Language-model scoring: a gated recurrent network in numpy, with a class-factored softmax.

Words are hashed (64 bits), counted over all training documents, and the CLASSES * SIZE - 1 most frequent of them, with
the end mark, are the network's vocabulary, cut into CLASSES classes by frequency. The probability of a word is that of
its class, given the state, times that of the word within the class. Words outside are one class more; within it each
has its count's share of the training words outside, one added to each and one share left for all words never seen.
So every word and every text has a probability, and base and model differ only in what the network learned.

One pass over the texts turns words into numbers of the vocabulary and notes, for each document, how many of its words have which
counts (FREQUENT counts at most are broadcast; those of all other words come from a join with the whole table of counts).

Training documents are dealt by hash into shards of about SHARD tokens, as many as the corpus needs, each split into ROUNDS
parts. In a round a shard's part is read in order of the hash, as streams side by side, forward over every word with the state
carried from window to window and dropped at a document's start, and backward within each window (truncated
backpropagation, Adagrad). All shards of a round begin with the same network, the first time one whose biases are the
corpus counts, and their networks are averaged by the number of words. So the network depends on the documents and not on
partitions or executors, up to the rounding of sums. What is gathered, counts and networks, grows with the input.

Scoring runs the whole of each document, state carried.

Nulls and the like: a null or empty text is its end mark alone. A null id is not held out. Rows that repeat are scored
alike, each on its own, and count as often as they come. Without any training document all words are unseen: base 0.
Very long texts are run to their end. Other columns play no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, released, span_hashes, stored, text_slices, word_bounds

CLASSES, SIZE, HIDDEN = 64, 64, 24
VOCABULARY = CLASSES * SIZE
FREQUENT = 1 << 18
LANES, WINDOW, RATE = 256, 16, 0.15
#: Tokens of a shard, about; rounds of training and averaging; tokens after which training drops the state within a long document, so that streams can be even.
SHARD, ROUNDS, RUN = 1 << 22, 3, 2048
#: Tokens that a task holds at once to train and to score, or a document more; streams scored side by side.
HELD, SCORE_HELD, SCORE_LANES = 1 << 20, 1 << 21, 1024
#: The end mark among the hashes of words.
END = np.uint64(0x5E5E5E5E5E5E5E5E)
_CHUNK = 1 << 12


# ---- words ----


def token_hashes(texts: pa.Array):
    """(first row, hashes, first token of each row and their number): the words of each text and its end mark."""
    for at, data, offsets in text_slices(texts):
        first, last, first_word = word_bounds(data, offsets, BLANKS)
        h = span_hashes(data, first, last)
        h[h == END] ^= np.uint64(1)
        rows = len(offsets) - 1
        ends = first_word[1:] + np.arange(rows)
        out = np.empty(len(h) + rows, np.uint64)
        word = np.ones(len(out), bool)
        word[ends] = False
        out[word] = h
        out[ends] = END
        yield at, out, np.concatenate([[0], ends + 1])


def _merged(parts):
    h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first)


def _count(batches):
    held, size = [], 0
    for batch in batches:
        for _, h, _ in token_hashes(batch.column(0)):
            held.append(np.unique(h, return_counts=True))
            size += len(held[-1][0])
            if size > 3_000_000:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield from _counted(*held[0])
                    held, size = [], 0
    if held:
        yield from _counted(*_merged(held))


def _counted(h, c):
    for at in range(0, len(h), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 16)].view(np.int64)), pa.array(c[at : at + (1 << 16)].astype(np.int64))], ["h", "c"])


def frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the words whose counts are above a cut, so low that at most so many are."""
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).count().collect()  # at most 8 * 63 rows
    total, cut = 0, None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        total += r["count"]
        if total > most:
            break
        cut = r["bin"]
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.where(F.floor(F.log2("c") * 8) >= cut).toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.lexsort((h, -c))
    return h[order], c[order]


# ---- the network ----


class Words:
    """The frequent words by hash: their counts, and their numbers in the vocabulary (by frequency; the end mark has one)."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        keep = h[h != END][: VOCABULARY - 1]
        at = int((h == END).argmax()) if (h == END).any() else 0
        self.vocabulary = np.concatenate([keep[:at], [END], keep[at:]]).astype(np.uint64)
        order = np.argsort(h)
        self.h, self.c = h[order], c[order].astype(np.int64)
        number = {int(x): i for i, x in enumerate(self.vocabulary)}
        self.number = np.array([number.get(int(x), -1) for x in self.h], np.int32)
        self.end = number[int(END)]
        counts = dict(zip(h.tolist(), c.tolist(), strict=True))
        self.counts = np.array([counts.get(int(x), 0) for x in self.vocabulary], np.int64)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in the vocabulary or -1, count or -1 where it isn't frequent) of each."""
        if not len(self.h):
            return np.where(h == END, self.end, -1).astype(np.int32), np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        same = self.h[at] == h
        return np.where(h == END, self.end, np.where(same, self.number[at], -1)).astype(np.int32), np.where(same, self.c[at], -1)


def initial(words: Words, n_all: int) -> dict[str, np.ndarray]:
    """The network before training: biases by the counts, small weights from a fixed seed."""
    rng = np.random.default_rng(11)
    p = {
        "E": rng.normal(0, 0.1, (VOCABULARY + 1, 3 * HIDDEN)), "U": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)), "Wc": np.zeros((HIDDEN, CLASSES + 1)), "bc": np.zeros(CLASSES + 1),
        "Ww": np.zeros((CLASSES, HIDDEN, SIZE)), "bw": np.full((CLASSES, SIZE), -30.0),
    }
    c = np.zeros(VOCABULARY)
    c[: len(words.counts)] = words.counts + 0.5
    of_class = c.reshape(CLASSES, SIZE).sum(axis=1)
    rest = max(0, n_all - words.counts.sum()) + 1
    p["bc"][:] = np.log(np.append(np.maximum(of_class, 1e-9), rest) / (of_class.sum() + rest))
    with np.errstate(divide="ignore"):
        p["bw"][:] = np.maximum(np.log(c.reshape(CLASSES, SIZE) / np.maximum(of_class[:, None], 1e-9)), -30)
    return {k: v.astype(np.float32) for k, v in p.items()}


def gathered(p, inputs):
    """The rows of E of inputs (time, lanes), as (time, 3, lanes, HIDDEN): each gate's together, as arithmetic over long runs is faster."""
    return p["E"].reshape(-1, HIDDEN).take(3 * inputs[:, None] + np.arange(3)[:, None], axis=0)


def step(p, h, x, room=(None, None, None, None)):
    """(gates z, r, candidate n, h @ Un, next h) for inputs x: rows of E, or (3, lanes, HIDDEN) of gathered(). room: where h @ U, the gates, the candidate and the next h go; h stays."""
    if x.ndim == 2:
        x = x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2)
    g = np.matmul(h, p["U"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2), out=room[0])
    a = np.add(x[:2], g[:2], out=room[1])
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    np.reciprocal(a, out=a)
    z, r, gn = a[0], a[1], g[2]
    n = np.multiply(r, gn, out=room[2])
    n += x[2]
    np.tanh(n, out=n)
    to = np.subtract(h, n, out=room[3])
    to *= z
    to += n
    return z, r, n, gn, to


#: Words whose probabilities are worked out together: so few that their logits stay in a core's cache. The largest logit in size.
ROWS, LOGIT = 1024, 40


def _sums(x):
    """The sum of each row, as a column's product: faster than a reduction over short rows."""
    return x @ np.ones(x.shape[1], x.dtype)


class Classed:
    """Words (-1: the class of all others) after the states hs, in order of their classes, in blocks of ROWS; weights have their biases as one row more, and states a one."""

    def __init__(self, p, hs, ids):
        cls = np.where(ids < 0, CLASSES, ids // SIZE).astype(np.uint16)
        self.order = np.argsort(cls, kind="stable")
        self.cls, self.word = cls[self.order], ids[self.order] % SIZE
        self.n = len(ids)
        self.own = int(np.searchsorted(self.cls, CLASSES))  # those after it are words outside
        self.x = np.ones((self.n, HIDDEN + 1), hs.dtype)
        self.x[:, :HIDDEN] = hs.take(self.order, axis=0)
        self.of_class = np.concatenate([p["Wc"], p["bc"][None]])
        self.of_word = np.concatenate([p["Ww"], p["bw"][:, None]], axis=1)
        # states are at most 1 in size, so as a rule no logit can be beyond the bounds, and there is nothing to clip
        reach = max(1.0, float(hs.max(initial=0)), -float(hs.min(initial=0)))
        self.bound = [reach * float(np.abs(w).sum(axis=-2).max()) > LOGIT - 0.1 for w in (self.of_class, self.of_word)]
        kind = np.result_type(hs, p["Wc"])
        self.logits, self.row = np.empty((ROWS, CLASSES + 1), kind), np.arange(ROWS)
        self.within = np.empty((ROWS, SIZE), kind)
        first = np.flatnonzero(np.concatenate([[True], (self.cls[1:] != self.cls[:-1]) | (np.arange(1, self.n) % ROWS == 0)])[: self.n])
        first = first[first < self.own]
        self.spans: dict[int, list[tuple[int, int, int]]] = {}
        for k, a, b in zip(self.cls[first].tolist(), first.tolist(), np.append(first, self.own)[1:].tolist(), strict=True):
            self.spans.setdefault(a // ROWS, []).append((k, a % ROWS, b - a + a % ROWS))

    def blocks(self):
        """(first and last place, states, logits of the classes, the spans (class, first, last) of the words within classes, their logits)."""
        for a in range(0, self.n, ROWS):
            b = min(a + ROWS, self.n)
            x, logits = self.x[a:b], self.logits[: b - a]
            np.matmul(x, self.of_class, out=logits)
            if self.bound[0]:
                np.clip(logits, -LOGIT, LOGIT, out=logits)
            spans = self.spans.get(a // ROWS, [])
            within = self.within[: spans[-1][2] if spans else 0]
            for k, i, j in spans:
                np.matmul(x[i:j], self.of_word[k], out=within[i:j])
            if self.bound[1]:
                np.clip(within, -LOGIT, LOGIT, out=within)
            yield a, b, x, logits, spans, within


def out_log_probs(p, hs, ids):
    """Natural log probabilities of words (-1: the class of all others) after the states hs."""
    c = Classed(p, hs, ids)
    out = np.empty(c.n, c.logits.dtype)
    for a, b, _, logits, _, within in c.blocks():
        m = len(within)
        found = logits[c.row[: b - a], c.cls[a:b]]
        found[:m] += within[c.row[:m], c.word[a : a + m]]
        found -= np.log(_sums(np.exp(logits, out=logits)))
        found[:m] -= np.log(_sums(np.exp(within, out=within)))
        out[c.order[a:b]] = found
    return out


def streams(starts: np.ndarray, lanes: int = SCORE_LANES) -> np.ndarray:
    """(lanes, longest): the places of tokens, documents end to end, about evenly long; -1 where a stream is over. starts: each document's first token, and the end."""
    sizes = np.diff(starts)
    lanes = int(max(1, min(lanes, len(sizes), -(-sizes.sum() // max(1, sizes.max(initial=1))) * 2)))
    heap = [(0, i) for i in range(lanes)]
    of: list[list[int]] = [[] for _ in range(lanes)]
    for d in np.argsort(-sizes, kind="stable"):
        used, i = heapq.heappop(heap)
        of[i].append(d)
        heapq.heappush(heap, (used + int(sizes[d]), i))
    rows = [np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs]) if docs else np.zeros(0, np.int64) for docs in of]
    rows.sort(key=len, reverse=True)
    out = np.full((lanes, len(rows[0])), -1, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _inputs(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a document begins, the network's input) at each token: the one before, at a beginning the end mark."""
    begins = np.zeros(len(ids) + 1, bool)
    begins[starts] = True
    before = np.concatenate([[end], ids[:-1]]) if len(ids) else ids
    before[starts[:-1]] = end
    return begins, np.where(before < 0, VOCABULARY, before)


def score_tokens(p, ids: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The natural log probability of each token given those before it in its document."""
    place = streams(starts)
    begins, before = _inputs(ids, starts, end)
    out = np.zeros(len(ids))
    h = np.zeros((len(place), HIDDEN), np.float32)
    width = max(WINDOW, (1 << 15) // len(place))
    for at in range(0, place.shape[1], width):
        part = place[:, at : at + width]
        live = int((part[:, 0] >= 0).sum())
        part, h = part[:live], h[:live]
        hs = np.empty((part.shape[1], live, HIDDEN), np.float32)
        x = gathered(p, before[np.maximum(part, 0)].T)
        fresh = begins[np.maximum(part, 0)].T
        room = (*(np.empty((k, live, HIDDEN), np.float32) for k in (3, 2)), np.empty((live, HIDDEN), np.float32))
        for t in range(part.shape[1]):
            if fresh[t].any():
                h = np.where(fresh[t][:, None], np.float32(0), h)
            h = step(p, h, x[t], (*room, hs[t]))[-1]
        where = part.T
        real = where >= 0
        if real.all():
            hs, where = hs.reshape(-1, HIDDEN), where.ravel()
        else:
            hs, where = hs[real], where[real]
        out[where] = out_log_probs(p, hs, ids[where])
    return out


def row_sums(values, rows, often: int = 16):
    """(the sums of the values of equal rows, those rows). The n-th of each are added at once, those of rows that come more often than that one row after another: faster than reduceat along the long axis."""
    order = np.argsort(rows.astype(np.uint16) if VOCABULARY < 1 << 16 else rows, kind="stable")
    by = rows[order]
    first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
    sizes = np.diff(np.append(first, len(by)))
    most = np.argsort(-sizes, kind="stable")
    first, sizes = first[most], sizes[most]
    out = values.take(order[first], axis=0)
    heavy = int(np.searchsorted(-sizes, -often))
    for i, (a, n) in enumerate(zip(first[:heavy].tolist(), sizes[:heavy].tolist(), strict=True)):
        np.add.reduce(values.take(order[a : a + n], axis=0), axis=0, out=out[i])
    for k in range(1, often):
        to = int(np.searchsorted(-sizes, -k))
        if to <= heavy:
            break
        out[heavy:to] += values.take(order[first[heavy:to] + k], axis=0)
    return out, by[first]


#: The axis over which a layer's squares of gradients are averaged between rounds.
_ROW = {"E": 1, "U": 0, "Wc": 0, "Ww": 1}


class Trainer:
    """Adagrad on windows of streams."""

    def __init__(self, p, seen=None):
        """seen: the squares of gradients so far of each row of a layer, as squares() gives them."""
        self.p = {k: v.copy() for k, v in p.items()}
        self.seen = {k: np.full(v.shape, 0.01, np.float32) if seen is None else np.broadcast_to(seen[k], v.shape).copy() for k, v in p.items()}
        self.tokens = 0

    def squares(self) -> dict[str, np.ndarray]:
        """The mean squares of gradients of each input word, word within a class, and class."""
        return {k: s.mean(axis=_ROW[k], keepdims=True) if k in _ROW else s.copy() for k, s in self.seen.items()}

    def update(self, name, grad, rows=None):
        """grad is used up."""
        p, s = self.p[name], self.seen[name]
        by = grad * grad
        if rows is None:
            s += by
            np.sqrt(s, out=by)
        else:
            by += s.take(rows, axis=0)
            s[rows] = by
            np.sqrt(by, out=by)
        grad *= RATE
        grad /= by
        if rows is None:
            p -= grad
        else:
            p[rows] -= grad

    def window(self, h, inputs, fresh, ids, real):
        """One forward and backward pass; inputs, fresh, ids, real: (time, lanes). The state after it."""
        p, steps = self.p, len(inputs)
        x, cut = gathered(p, inputs), fresh.any(axis=1)
        lanes, size = h.shape
        # few large arrays, filled in place: those of all tasks of a machine share its caches
        hs, was, n, gn = (np.empty((steps, lanes, size), np.float32) for _ in range(4))
        inner, gates = np.empty((3, lanes, size), np.float32), np.empty((steps, 2, lanes, size), np.float32)
        for t in range(steps):
            was[t] = np.where(fresh[t][:, None], np.float32(0), h) if cut[t] else h
            gn[t], h = step(p, was[t], x[t], (inner, gates[t], n[t], hs[t]))[-2:]
        h, z, r = h.copy(), gates[:, 0], gates[:, 1]
        whole = bool(real.all())
        if whole:
            dhs = self.output(hs.reshape(-1, HIDDEN), ids.ravel()).reshape(hs.shape)
        else:
            dhs = np.zeros_like(hs)
            dhs[real] = self.output(hs[real], ids[real])
        # what a step's gradient is multiplied by on its way to the gates and to h @ U, for all steps at once
        g, rest = np.empty((steps, 3, lanes, size), np.float32), 1 - z
        np.multiply(z, rest, out=g[:, 0])
        g[:, 0] *= was - n
        to_n = np.multiply(n, n, out=n)
        np.subtract(1, to_n, out=to_n)
        to_n *= rest
        np.multiply(to_n, r, out=g[:, 2])
        np.subtract(1, r, out=r)
        r *= gn
        np.multiply(g[:, 2], r, out=g[:, 1])
        back, back_u = np.zeros_like(h), np.ascontiguousarray(p["U"].reshape(size, 3, size).transpose(1, 2, 0))
        for t in range(steps - 1, -1, -1):
            d = dhs[t]
            d += back
            g[t] *= d
            to_h = np.matmul(g[t], back_u, out=inner)
            np.multiply(d, z[t], out=back)
            for part in to_h:
                back += part
            if cut[t]:
                back[fresh[t]] = 0
        # x has had its use: its room, by input, is that of the gradients of the inputs
        dx = x.reshape(steps, lanes, 3, size)
        dx[:, :, 0], dx[:, :, 1] = g[:, 0], g[:, 1]
        np.multiply(dhs, to_n, out=dx[:, :, 2])
        dx = dx.reshape(steps, lanes, 3 * size)
        du = np.matmul(was.transpose(0, 2, 1)[:, None], g).sum(axis=0).transpose(1, 0, 2).reshape(size, 3 * size)
        flat, rows = (dx.reshape(-1, 3 * HIDDEN), inputs.ravel()) if whole else (dx[real], inputs[real])
        if len(rows):
            grad, rows = row_sums(flat, rows)
            self.update("E", np.clip(grad, -1, 1), rows)
        self.update("U", np.clip(du, -1, 1))
        return h

    def output(self, hs, ids):
        """Updates the output layers; the gradient of the states, which takes their place."""
        p, c, scale = self.p, Classed(self.p, hs, ids), np.float32(0.02)
        g_class, g_word = np.zeros_like(c.of_class), np.zeros_like(c.of_word)
        to_class, to_word = p["Wc"].T, p["Ww"].transpose(0, 2, 1)
        inner = np.empty((ROWS, HIDDEN), hs.dtype)
        for a, b, x, d, spans, e in c.blocks():
            # what each row is divided by comes in where it is short: in the states and in their gradients
            m = len(e)
            total = _sums(np.exp(d, out=d))
            d[c.row[: b - a], c.cls[a:b]] -= total
            share = (1 / total)[:, None]
            back = d @ to_class
            back *= share
            g_class += (x * share).T @ d
            if m:
                total = _sums(np.exp(e, out=e))
                e[c.row[:m], c.word[a : a + m]] -= total
                share = (1 / total)[:, None]
                own, within = x[:m] * share, inner[:m]
                for k, i, j in spans:
                    np.matmul(e[i:j], to_word[k], out=within[i:j])
                    g_word[k] += own[i:j].T @ e[i:j]
                within *= share
                back[:m] += within
            back *= scale
            hs[c.order[a:b]] = back
        g_class *= scale
        g_word *= scale
        self.update("Ww", g_word[:, :HIDDEN])
        self.update("bw", g_word[:, HIDDEN])
        self.update("Wc", g_class[:HIDDEN])
        self.update("bc", g_class[HIDDEN])
        return hs

    def read(self, ids: np.ndarray, starts: np.ndarray, end: int):
        sizes = np.diff(starts)
        runs = -(-sizes // RUN)
        inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        runs = np.append(np.repeat(starts[:-1], runs) + RUN * inside, starts[-1])
        place = streams(runs, min(LANES, max(32, len(ids) // 1024)))
        begins, before = _inputs(ids, starts, end)
        begins[runs] = True
        h = np.zeros((len(place), HIDDEN), np.float32)
        for at in range(0, place.shape[1], WINDOW):
            part = place[:, at : at + WINDOW]
            live = int((part[:, 0] >= 0).sum())
            part, h = part[:live].T, h[:live]
            safe = np.maximum(part, 0)
            h = self.window(h, before[safe], begins[safe], ids[safe], part >= 0)
        self.tokens += len(ids)


def packed(p) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpacked(flat, like) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


# ---- over tables ----


def held_out(id_col: str):
    """True of the documents that the contract keeps from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _held(batches, column: str, most: int, key: str | None = None):
    """Rows together with up to so many tokens (of two bytes), or a row more, and of one key only."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        keys = batch.column(key).to_numpy() if key else np.zeros(batch.num_rows, np.int64)
        at = 0
        while at < batch.num_rows:
            if held and key and held[-1].column(key)[0].as_py() != keys[at]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            same = at + int(np.argmin(np.append(keys[at:] == keys[at], False)))
            to = min(same, at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most - n, "right"))))
            held.append(batch.slice(at, to - at))
            n += int(sizes[at:to].sum())
            at = to
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers in the vocabulary, -1 for words outside; each row's first token, and the end)."""
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2)])
    ids = np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64)
    return np.where(ids == VOCABULARY, -1, ids), starts


def _train(shared):
    def train(batches):
        end, first, seen = shared.value
        trainer, at, total, count = None, None, 0.0, 0

        def closed():
            nonlocal total, count
            if trainer is not None:
                total = total + np.concatenate([packed(trainer.p), packed(trainer.squares())]).astype(np.float64) * trainer.tokens
                count += trainer.tokens

        for part in _held(batches, "ids", HELD, "shard"):
            if part.column("shard")[0].as_py() != at:
                closed()
                trainer, at = Trainer(first, seen), part.column("shard")[0].as_py()
            ids, starts = _ids(part.column("ids"))
            trainer.read(ids, starts, end)
        closed()
        if count:
            mean = (total / count).astype(np.float32)
            for chunk in range(0, len(mean), _CHUNK):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "n": pa.array([count], pa.int64()), "w": pa.array([mean[chunk : chunk + _CHUNK].tobytes()], pa.binary())})

    return train


def _averaged(key, data):
    total, n = 0.0, 0
    for part, m in zip(data.column("w").to_pylist(), data.column("n").to_pylist(), strict=True):
        total, n = total + np.frombuffer(part, np.float32).astype(np.float64) * m, n + m
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "w": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})


def fit(train: DataFrame, words: Words, n_all: int) -> dict[str, np.ndarray]:
    """The network after all rounds. train: key (a hash that orders documents) and ids of each; it is read once a round."""
    spark = train.sparkSession
    net, seen = initial(words, n_all), None
    shards = max(1, -(-n_all // SHARD))
    dealt = train.select("ids", "key", F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64(F.lit("round"), "key"), F.lit(ROUNDS)).alias("round"))
    form = "chunk int, n long, w binary"
    like = {k: s for k, s in Trainer(net).squares().items()}
    size = sum(v.size for v in net.values())
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((words.end, net, seen))  # of fixed size
        mine = dealt.where(F.col("round") == r).select("ids", "key", "shard").repartition("shard").sortWithinPartitions("shard", "key", "ids")
        parts = mine.mapInArrow(released(_train(shared)), form)
        mid = parts.withColumn("salt", F.spark_partition_id() % 32).groupBy("chunk", "salt").applyInArrow(_averaged, form)
        got = {x.chunk: np.frombuffer(x.w, np.float32) for x in mid.groupBy("chunk").applyInArrow(_averaged, form).collect()}  # the network, once
        if got:
            flat = np.concatenate([got[k] for k in sorted(got)])
            net, seen = unpacked(flat[:size], net), unpacked(flat[size:], like)
    return net


def _numbered(shared):
    """From texts to the numbers of their words, and what the counts of the frequent words say about each."""

    def numbered(batches):
        words = shared.value
        for batch in batches:
            for first_row, h, starts in token_hashes(batch.column("text")):
                rows = len(starts) - 1
                part = batch.slice(first_row, rows)
                ids, c = words.look_up(h)
                row = np.repeat(np.arange(rows), np.diff(starts))
                known = c >= 0
                total = lambda x: np.bincount(row, weights=x, minlength=rows)  # noqa: E731,B023
                log_c = np.where(known, np.log10(np.maximum(c, 0) + 1), 0)
                rare, rare_row = h[~known], row[~known]
                order = np.lexsort((rare, rare_row))
                rare, rare_row = rare[order], rare_row[order]
                first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])])) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rare)))
                cuts = np.searchsorted(rare_row[first], np.arange(rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (rare[first].view(np.int64), times.astype(np.int64))]
                data = np.where(ids < 0, VOCABULARY, ids).astype("<u2").tobytes()
                coded = pa.array([data[2 * a : 2 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in ("rid", "doc_id", "held_out", "key")), coded, pa.array(np.diff(starts)), pa.array(total(known & (c > 0)).astype(np.int64)), pa.array(total(log_c)),
                     pa.array(total(ids < 0).astype(np.int64)), pa.array(total(np.where(ids < 0, log_c, 0))), *lists],
                    ["rid", "doc_id", "held_out", "key", "ids", "n_tokens", "n_known", "log_c", "n_outside", "log_outside", "rare", "times"],
                )

    return numbered


_KEPT = ("rid", "doc_id", "held_out", "n_tokens", "n_known", "log_c", "n_outside", "log_outside")


def _score(shared):
    def score(batches):
        end, net = shared.value
        for part in _held(batches, "ids", SCORE_HELD):
            ids, starts = _ids(part.column("ids"))
            row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            model = np.bincount(row, weights=score_tokens(net, ids, starts, end), minlength=len(starts) - 1) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in _KEPT), pa.array(model)], [*_KEPT, "model"])

    return score


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    train = docs.where(~held_out(id_col)).select(F.col(text_col).alias("text"))
    counts = stored(train.mapInArrow(released(_count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = whole["n"] or 0, whole["v"]
    words = Words(*frequent(counts))
    n_out = n - int(words.counts.sum())
    v_out = v - int((words.counts > 0).sum())
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), key.alias("key"), F.col(text_col).alias("text"))
    form = f"rid long, doc_id {kind}, held_out boolean, key long, ids binary, n_tokens long, n_known long, log_c double, n_outside long, log_outside double, rare array<long>, times array<long>"
    numbered = stored(rows.mapInArrow(released(_numbered(spark.sparkContext.broadcast(words))), form), "lm-numbered")  # the words: FREQUENT at most
    net = fit(numbered.where(~F.col("held_out")), words, n)
    shared = spark.sparkContext.broadcast((words.end, net))  # of fixed size
    form = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_c double, n_outside long, log_outside double, model double"
    scored = numbered.select(*_KEPT, "ids").mapInArrow(released(_score(shared)), form)
    rare = numbered.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("m"))
    found = rare.join(counts, "h").select("rid", "m", "c")
    sums = found.groupBy("rid").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("log_more"))
    out = scored.join(sums, "rid", "left")
    more, log_more = F.coalesce("more", F.lit(0)), F.coalesce("log_more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_c") + log_more - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("model") + F.col("log_outside") + log_more - F.col("n_outside") * F.lit(float(np.log10(n_out + v_out + 1)))).alias("score"),
    )
