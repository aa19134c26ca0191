import math
import random
import re
from collections import Counter

import numpy as np

from vigil.llm import lexical as L

DOCS, ITEMS = "doc_id long, text string, item_id string, rank int", "item_id string, text string, score long"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    bags = [(d[0], Counter(terms(d[1]))) for d in docs if terms(d[1])]
    n, length, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    asked = {}
    for i, text, *_ in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, ts in asked.items():
        found = []
        for doc, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in ts if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k])]
    return out


def made():
    rng = random.Random(3)
    vocab = [f"W{i}" for i in range(200)] + ["été", "日本", "x9"]
    docs = [(i * 3 % 500, ", ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=rng.choice([1, 4, 30, 200]))), "z", 0) for i in range(500)]
    docs += [(900, None, "z", 0), (901, "", "z", 0), (902, " ..", "z", 0), (903, "w1 " * 30000, "z", 0), (None, docs[0][1], "z", 0), (None, docs[0][1], "z", 0), *docs[:5]]
    items = [(f"i{i}", " ".join(rng.choices(vocab, k=rng.choice([1, 5, 40]))), 1) for i in range(30)]
    return docs, items + [("none", "nowhere", 1), ("null", None, 1), (None, "w3 w4", 1), ("i0", "w7", 1), ("all", " ".join(vocab), 1)]


def test_against_brute_force(spark, monkeypatch):
    docs, items = made()
    want = sorted(map(repr, brute(docs, items)))
    frames = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    for how in ({}, {"SHARD_DOCS": 7, "OPENED": 3}, {"SHARD_POSTINGS": 90, "BLOCK_BYTES": 1000}):
        with monkeypatch.context() as m:
            for name, value in how.items():
                m.setattr(L, name, value)
            assert sorted(repr(tuple(r)) for r in L.search(*frames).collect()) == want


def test_empty_tables(spark):
    docs, items = made()
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert L.search(none, spark.createDataFrame(items, ITEMS)).collect() == []
    assert L.search(spark.createDataFrame(docs, DOCS), no_items).collect() == []


def test_bounds_leave_nodes_unopened():
    """Few documents hold the query's rare terms: most of the tree stays closed, and the best are right."""
    rng = np.random.default_rng(4)
    docs, vocab = 4096, 12
    held = rng.random((docs, vocab)) < np.geomspace(0.3, 0.001, vocab)
    d, t = np.nonzero(held)
    impacts = rng.integers(1, 1000, len(d))
    shard = L.Shard(np.arange(docs), d, t, impacts, vocab)
    weights = np.linspace(500, 5000, vocab).astype(np.int64)
    full = np.zeros((docs, vocab), np.int64)
    full[d, t] = impacts
    scores = full @ weights
    at, found, opened = shard.search(np.arange(vocab), weights, 10)
    want = np.lexsort((np.arange(docs), -scores))[:10]
    assert at.tolist() == want.tolist() and found.tolist() == scores[want].tolist() and opened < docs / 4
    assert len(shard.search(np.arange(vocab), weights, 10, int(scores.max()) + 1)[0]) == 0
