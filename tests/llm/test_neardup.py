import random

import numpy as np
from pyspark.sql import functions as F

from vigil.llm import neardup as N

DOCS = "doc_id long, text string, label long, bucket int"


def shingles(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k):
    """(id, set size, component) of each row."""
    sets = [shingles(t, k) for _, t, *_ in docs]
    root = {d[0]: d[0] for d in docs if d[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(docs[i][0]), find(docs[j][0])))
                    root[b] = a
    return sorted(repr((d[0], len(s), None if d[0] is None else find(d[0]))) for d, s in zip(docs, sets, strict=True))


def made(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for group in range(14):
        base = rng.choices(vocab, k=rng.choice([3, 8, 30, 120, 400]))
        chain = list(base)
        for _ in range(rng.choice([1, 1, 4, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 25, len(base) // 18])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            docs.append((n, " ".join(text)))
            n += 1
        for _ in range(group % 3 * 3):
            chain[rng.randrange(len(chain))] = rng.choice(vocab)
            docs.append((n, " \n".join(chain).upper()))
            n += 1
    rng.shuffle(docs)
    odd = [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (None, docs[0][1]), (docs[3][0], docs[3][1]), (docs[3][0], "quite another text of its own here"), (905, "quite another text of its own here"), (906, "xx yy " * 20000)]
    return [(*d, 0, 1) for d in docs + odd]


def test_against_brute_force(spark):
    for k in (2, 5):
        docs = made(k)
        got = N.classes(spark.createDataFrame(docs, DOCS), words=k).collect()
        assert sorted(repr((r.id, r.n_shingles, r.component)) for r in got) == brute(docs, k)


def test_keep(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_IDS", -1)
    docs = made(7)
    df = spark.createDataFrame(docs, DOCS)
    kept = N.keep(df)
    assert kept.columns == df.columns
    want = {r for r in (eval(x) for x in brute(docs, 5))}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, _, c in want if i is not None and i == c}) and ids.count(None) == 1
    assert N.keep(df.limit(0)).count() == 0 and N.classes(df.limit(0)).count() == 0


def test_sketch_estimates_high_similarities():
    rng = np.random.default_rng(0)
    for j in (0.8, 0.9, 0.97):
        for _ in range(20):
            x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
            y = x.copy()
            away = round(3000 * (1 - j) / (1 + j))
            y[:away] = rng.integers(0, 1 << 63, away).astype(np.uint64)
            a, b = (N.odd_sketch(N.samples(s)).view(np.uint64) for s in (x, y))
            differ = int(np.bitwise_count(a ^ b).sum())
            n = 64 * N.SKETCH_WORDS
            guess = 1 + n / (4 * N._SAMPLES) * np.log(1 - 2 * differ / n)
            assert abs(guess - j) < 0.12 and differ <= N.most_different(0.8)


def test_sketch_limits_lie_six_deviations_out():
    rng = np.random.default_rng(9)
    for many, words, margin in ((N._SAMPLES, N.SKETCH_WORDS, N.MARGIN), (N.FINE_SAMPLES, N.FINE_WORDS, N.FINE_MARGIN)):
        bits = []
        for apart in rng.binomial(many, 0.2, 3000):  # of two sets of similarity 0.8; a sample that differs flips a bit for each
            bits.append((np.bincount(rng.integers(0, 64 * words, 2 * apart), minlength=64 * words) & 1).sum())
        assert N.most_different(0.8, many, words, margin) > np.mean(bits) + 6 * np.std(bits)


def thue_morse(n):
    bits = np.array([0])
    while len(bits) < n:
        bits = np.concatenate([bits, 1 - bits])
    return "".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])


def test_structured_words_do_not_collide(spark):
    x, y = thue_morse(2048)
    docs = [(1, f"{x} {x}", 0, 1), (2, f"{y} {y}", 0, 1), (3, f"{x} {y} {x} {y}", 0, 1), (4, f"{y} {x} {y} {x}", 0, 1), (5, f"{x.upper()} {x}", 0, 1)]
    got = {r.id: (r.n_shingles, r.component) for r in N.classes(spark.createDataFrame(docs, DOCS), words=2).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 3), 4: (2, 3), 5: (1, 1)}


def test_word_hashes_depend_on_bytes_and_places_only():
    from vigil.llm.common import span_hashes

    words = ["a", "b", "ab", "ba", "aa", "a" * 63, "a" * 64, "a" * 65, "b" + "a" * 64, "a" * 64 + "b", *thue_morse(1024)]
    text = " ".join(words * 2).encode()
    data = np.frombuffer(text, np.uint8)
    last = np.cumsum([len(w) + 1 for w in words * 2]) - 1
    first = last - [len(w) for w in words * 2]
    h = span_hashes(data, first, last)
    assert (h[: len(words)] == h[len(words) :]).all() and len(set(h.tolist())) == len(words)


def test_keep_survives_any_column_name(spark):
    rows = [(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y"), (1, "a b c d e f", 3, "z"), (None, None, 4, None), (3, "", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, `__id` string").withColumns({"row": F.lit(1), "n": F.lit(2), "fp": F.lit("q"), "a.b": F.lit(3)})
    kept = N.keep(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]
    assert kept.where("doc_id = 1").first().id == N.keep(df.orderBy(F.desc("id"))).where("doc_id = 1").first().id


def test_recall_on_thousands_of_pairs(spark):
    """Pairs at and above the threshold, one in three right at it, among unlike texts: none may be lost."""
    rng = random.Random(11)
    docs, want = [], {}
    for i in range(0, 5000, 2):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([45, 90, 180]))]
        other = list(base)
        n = len(base) - 4  # a word changed amid the others spoils five shingles of n: similarity (n - 5k) / (n + 5k)
        most = n // 45
        for k in range(most if i % 3 == 0 else rng.randint(0, most)):
            other[10 + 9 * k] = f"z{i}.{k}"
        a, b = shingles(" ".join(base), 5), shingles(" ".join(other), 5)
        linked = 100 * len(a & b) >= 80 * len(a | b)
        docs += [(i, " ".join(base), 0, 1), (i + 1, " ".join(other), 0, 1)]
        want |= {i: i, i + 1: i if linked else i + 1}
    got = {r.id: r.component for r in N.classes(spark.createDataFrame(docs, DOCS).repartition(4)).collect()}
    assert got == want
