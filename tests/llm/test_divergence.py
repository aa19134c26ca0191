import random
import re
from collections import Counter, defaultdict

import numpy as np

from vigil.llm import divergence as D

DOCS = "doc_id long, text string, lang string, source string, n long, rank int"


def brute(docs, least):
    by, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        by[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        mine = sorted(s for x, s in groups if x == lang)
        total = {t: sum(by[lang, s][t] for s in mine) for t in kept}

        def share(c, n):
            return 1 + (10**9 * (c + 5)) // (n + 5 * len(kept))

        p = {s: {t: share(by[lang, s][t], sum(by[lang, s][x] for x in kept)) for t in kept} for s in mine}
        q = {t: share(total[t], sum(total.values())) for t in kept}
        for s in mine:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if by[lang, s][t] and p[s][t] > q[t])[:50]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)] + [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms)]
    return sorted(out)


def made():
    rng = random.Random(7)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Éa", "éa", "ñ", "日本"]
    docs = []
    for i in range(400):
        lang = rng.choice(["en", "en", "fr", None, "xx"])
        source = rng.choice([None, "", "hot", "hot", "hot"] + [f"s{k}" for k in range(30)])
        text = " 1,".join(rng.choices(vocab, weights=range(len(vocab), 0, -1), k=rng.choice([0, 1, 5, 60]))).upper() if lang != "xx" else "all alone" + str(i)
        docs.append((i, rng.choice([text, text, None]), lang, source, 1, 2))
    return docs + docs[:7] + [(999, "waa " * 30000, "en", "long", 0, 0), (1000, "..12", "zz", "only", 0, 0), (1001, "", "zz", "other", 0, 0)]


def test_against_brute_force(spark, monkeypatch):
    for k, v in (("BUCKET", 40), ("RESIDENTS", 2), ("SLICE", 3000)):
        monkeypatch.setattr(D, k, v)
    docs = made()
    got = sorted(tuple(r) for r in D.audit(spark.createDataFrame(docs, DOCS).repartition(5), least=3).collect())
    assert got == brute(docs, 3)


def test_empty(spark):
    assert D.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_each_two_cells_meet_once(spark):
    from pyspark.sql import functions as F

    for cells in range(1, 12):
        rows = spark.range(cells).select(F.col("id").cast("int").alias("c"), F.explode(D.hosts(F.col("id").cast("int"), F.lit(cells))).alias("h")).select("c", "h.cell", "h.round").collect()
        assert sorted(tuple(sorted(r[:2])) for r in rows) == [(i, j) for i in range(cells) for j in range(i + 1, cells)]
        for n in {r["round"] for r in rows}:  # in a round each cell takes part once
            both = [x for r in rows if r["round"] == n for x in r[:2]]
            assert len(both) == len(set(both))


def test_shares_and_vectors_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        whole, terms = rng.randrange(1, 10**15), rng.randrange(1, 10**6)
        counts = [rng.randrange(whole) for _ in range(5)]
        assert D.shares(np.array(counts), whole, terms).tolist() == [1 + (10**9 * (c + 5)) // (whole + 5 * terms) for c in counts]
    assert D.unpack(D.pack(np.array([7, 2, 0]), np.array([5, 1 << 40, 9])), 9).tolist() == [9, 0, 1 << 40, 0, 0, 0, 0, 5, 0]
    assert D.unpack(None, 2).tolist() == [0, 0]
