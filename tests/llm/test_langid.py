import random
import zlib

import numpy as np
import pyarrow as pa

from vigil.llm import langid as L

DOCS = "doc_id long, text string, lang string, score int"
WORDS = {"aa": ["tho", "the", "ing", "wha"], "bb": ["qué", "ñol", "ció", "los"], "cc": ["schö", "über", "ung", "ich"]}


def made(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang, 0) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy(spark):
    docs = made(400)
    odd = [(1000, None, "aa", 0), (1001, "12 34 !!", "aa", 0), (1002, "", None, 0), (None, docs[0][1], docs[0][2], 0), (3, docs[3][1], None, 0), (1003, docs[5][1] + " " + docs[5][1] * 3000, docs[5][2], 0)]
    got = L.predict(spark.createDataFrame(docs + odd, DOCS)).collect()
    assert len(got) == len(docs) + len(odd)
    lang = {d[0]: d[2] for d in docs} | {1003: docs[5][2]}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id is not None:
            assert r.lang_pred == lang[r.doc_id]
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        else:
            assert not r.held_out and r.lang_pred == docs[0][2]


def test_mixture_against_plain_em():
    rng = np.random.default_rng(2)
    for share in (1.0, 0.7, 0.5):
        like = rng.normal(size=(400, 3)) * 0.5
        cut = int(400 * share)
        like[:cut, 0] += 6
        like[cut:, 2] += 6
        best, got = L.mixture(like, np.array([0, 400, 400]))
        p = np.full(3, 1 / 3)
        x = np.exp(like - like.max(axis=1, keepdims=True))
        for _ in range(200):
            j = x * p
            p = (j / j.sum(axis=1, keepdims=True)).mean(axis=0)
        assert abs(got[0] - p.max()) < 0.03 and got[1] == 0
        assert share == 0.5 or best[0] == p.argmax()


def test_nothing_learned_and_keep(spark):
    docs = spark.createDataFrame(made(30), DOCS)
    assert L.predict(docs.limit(0)).count() == 0
    none = L.predict(docs.withColumn("lang", docs.lang.substr(99, 1)).withColumn("lang", L.F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    kept = L.keep(docs.union(spark.createDataFrame([(99, "...", "aa", 0)], DOCS)))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_letters_beyond_ascii():
    names, model = ["x"], np.zeros((1, 3, 1 << L.BITS), np.float32)
    said, _ = L.classify(pa.array(["é", "1", "Ж.", None, "·"]), names, model)
    assert list(said) == ["x", "und", "x", "und", "und"]
