"""Language identification: each text is a mixture of languages, inferred by expectation-maximisation.

A language's model gives a word its likelihood: the product of the probabilities of the word's byte n-grams (1 to 3
bytes, hashed into a table of fixed size, the word's ends counted as blanks). A text's language proportions are those
that maximise the likelihood of its words under the mixture. The set of languages is chosen by penalised likelihood:
beginning with the best single language, the language that raises the likelihood most is added as long as it raises
it by more than PENALTY times the logarithm of the number of words. The prediction is the language of the largest
proportion, the score its proportion.

The models are fitted on a sample of at most FIT_ROWS documents of known language, those with the smallest hash of
their id; whole texts are counted and whole texts are scored.

Nulls and the like: a null text, and one without any letter, is `und` with score 0. Rows with a null language or a
null id are not learned from, but are predicted. Equal languages' likelihoods: the smaller name. Rows that repeat are
predicted alike. With nothing to learn from, all are `und`. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, mix64, release, released, stored, text_slices, word_bounds

BITS = 16
#: At most so many documents of known language are read to fit the models.
FIT_ROWS = 20_000
SMOOTHING = 0.5
PENALTY = 1.0
ROUNDS = 8
UNKNOWN = "und"
_ORDERS = (1, 2, 3)
_LETTER = regex.compile(r"\p{L}")
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[BLANKS == 1] = 32


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(orders, bytes): the buckets of the n-grams that end at each byte; blanks stand before a row."""
    text = _fold[data].astype(np.uint64)
    one = text
    before = np.empty_like(text)
    before[1:] = text[:-1]
    before[offsets[:-1][offsets[:-1] < len(text)]] = 32
    third = np.empty_like(text)
    third[1:] = before[:-1]
    third[offsets[:-1][offsets[:-1] < len(text)]] = 32
    shift = np.uint64(64 - BITS)
    two = (before << np.uint64(8)) | one
    three = (third << np.uint64(16)) | two
    grams = [mix64(x + np.uint64(k << 40)) >> shift for k, x in zip(_ORDERS, (one, two, three), strict=True)]
    return np.stack(grams).astype(np.int32)


def train_split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> DataFrame:
    """__text, __lang of at most so many rows with an id and a language; rows that repeat count once."""
    keys = [F.col(id_col).alias("i"), F.col(lang_col).alias("__lang"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")]
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(*keys)
    picked = known.orderBy(F.xxhash64("i"), "i", "h", "__lang").limit(rows).distinct()
    marked = docs.select(*keys, F.col(text_col).alias("__text"))
    return marked.join(F.broadcast(picked), ["i", "__lang", "h"]).groupBy("i", "__lang", "h").agg(F.first("__text").alias("__text")).select("__text", "__lang")


def _counts(batches):
    """This task's counts of each language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("__lang").to_pylist(), object)
        for at, text, offsets in text_slices(batch.column("__text")):
            grams = gram_buckets(text, offsets)
            lang = np.repeat(langs[at : at + len(offsets) - 1], np.diff(offsets))
            for name in set(langs[at : at + len(offsets) - 1]):
                mine = total.setdefault(name, np.zeros((len(_ORDERS), 1 << BITS), np.int64))
                for k in range(len(_ORDERS)):
                    mine[k] += np.bincount(grams[k][lang == name], minlength=1 << BITS)
    for name, counts in total.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name]), "counts": pa.array([counts.tobytes()], pa.binary())})


def _summed(key, data):
    total = sum(np.frombuffer(part, np.int64) for part in data.column("counts").to_pylist())
    return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})


def fit(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities: languages, orders, buckets). The sample is bounded, and so are its 16 tasks' counts."""
    form = "lang string, counts binary"
    parts = sample.repartition(16).mapInArrow(released(_counts), form)
    found = {r.lang: np.frombuffer(r.counts, np.int64).reshape(len(_ORDERS), -1) for r in parts.groupBy("lang").applyInArrow(_summed, form).collect()}  # a row a language
    names = sorted(found)
    model = np.zeros((len(names), len(_ORDERS), 1 << BITS), np.float32)
    for i, name in enumerate(names):
        c = found[name] + SMOOTHING
        model[i] = np.log(c / c.sum(axis=1, keepdims=True))
    return names, model


def mixture(words: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language of the largest proportion, its proportion) of each text. words: log likelihoods (words, languages); first_word: where each text's begin, and the end."""
    rows, n = len(first_word) - 1, words.shape[1]
    best, share = np.zeros(rows, np.int64), np.zeros(rows)
    sizes = np.diff(first_word)
    full = np.flatnonzero(sizes)
    if not len(full) or not n:
        return best, share
    row_of = np.repeat(np.arange(len(full)), sizes[full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    top = words.max(axis=1, keepdims=True)
    like = np.exp(words - top)  # relative to the word's best language
    like = np.maximum(like, 1e-30)
    log_like = np.log(like)
    single = np.add.reduceat(log_like, starts, axis=0)
    chosen = np.zeros((len(full), n), bool)
    chosen[np.arange(len(full)), single.argmax(axis=1)] = True
    now = single.max(axis=1)
    pi = chosen.astype(float)
    open_rows = np.ones(len(full), bool)
    for _ in range(n - 1):
        # the language not yet chosen whose words the present mixture explains worst
        mixed = (like * pi[row_of]).sum(axis=1)
        gain = np.add.reduceat(np.maximum(0, log_like - np.log(np.maximum(mixed, 1e-30))[:, None]), starts, axis=0)
        gain[chosen] = -1
        more = gain.argmax(axis=1)
        could = open_rows & (gain.max(axis=1) > PENALTY * np.log(sizes[full] + 1))
        if not could.any():
            break
        at = np.flatnonzero(could)
        words_at = could[row_of]
        sub_like, sub_row = like[words_at], np.repeat(np.arange(len(at)), sizes[full][at])
        sub_starts = np.concatenate([[0], np.cumsum(sizes[full][at])[:-1]])
        try_set = chosen[at].copy()
        try_set[np.arange(len(at)), more[at]] = True
        p = np.where(try_set, np.maximum(pi[at], 0.1), 0.0)
        p /= p.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            joint = sub_like * p[sub_row]
            joint /= joint.sum(axis=1, keepdims=True)
            p = np.add.reduceat(joint, sub_starts, axis=0) / sizes[full][at][:, None]
        reached = np.add.reduceat(np.log(np.maximum((sub_like * p[sub_row]).sum(axis=1), 1e-30)), sub_starts)
        better = reached - now[at] > PENALTY * np.log(sizes[full][at] + 1)
        win = at[better]
        chosen[win], pi[win], now[win] = try_set[better], p[better], reached[better]
        open_rows[:] = False
        open_rows[win] = True
    best[full], share[full] = pi.argmax(axis=1), pi.max(axis=1)
    return best, np.minimum(share, 1.0)


def classify(texts: pa.Array, names: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(predicted names, scores) of texts."""
    said, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if not names:
        return said, score
    for at, data, offsets in text_slices(texts, 1 << 18):
        if not len(data):
            continue
        first, last, first_word = word_bounds(data, offsets, BLANKS)
        if not len(first):
            continue
        grams = gram_buckets(data, offsets)
        words = np.zeros((len(first), len(names)), np.float64)
        for i in range(len(names)):
            per_byte = model[i, 0][grams[0]]
            for k in range(1, len(_ORDERS)):
                per_byte = per_byte + model[i, k][grams[k]]
            total = np.concatenate([[0.0], np.cumsum(per_byte, dtype=np.float64)])
            words[:, i] = total[np.minimum(last + 1, np.append(first[1:], len(data)))] - total[first]
        best, share = mixture(words, first_word)
        rows = len(offsets) - 1
        ascii_letter = np.zeros(rows, bool)
        letters = np.add.reduceat(np.append(((data | 32) >= 97) & ((data | 32) <= 122), False).astype(np.int64), np.minimum(offsets[:-1], len(data)))
        ascii_letter[:] = (letters > 0) & (np.diff(offsets) > 0)
        raw = data.tobytes()
        for r in range(rows):
            if ascii_letter[r] or (offsets[r + 1] > offsets[r] and _LETTER.search(raw[offsets[r] : offsets[r + 1]].decode("utf-8", "ignore"))):
                said[at + r], score[at + r] = names[best[r]], share[r]
    return said, score


def predictor(spark, names: list[str], model: np.ndarray):
    """A function from a text column to struct<lang, score>."""
    shared = spark.sparkContext.broadcast((names, model))  # 3 * 4 * 2 ** BITS bytes a language

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        said, score = classify(text, *shared.value)
        release()
        return pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(score)], ["lang", "score"])

    return predict


def held_out(id_col):
    """True of the documents that the contract keeps from the fit."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs, learned from those not held out."""
    said = _fitted(docs, id_col, text_col, lang_col)(F.col(text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), said.alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def _fitted(docs, id_col, text_col, lang_col):
    sample = stored(train_split(docs.where(~held_out(id_col)), id_col, text_col, lang_col), "langid-sample")
    return predictor(docs.sparkSession, *fit(sample))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.4) -> DataFrame:
    """The rows of docs, as they came, whose text has a language, of at least such a proportion."""
    said = _fitted(docs, id_col, text_col, lang_col)(F.col(text_col))
    return docs.where((said["lang"] != UNKNOWN) & (said["score"] >= least))
