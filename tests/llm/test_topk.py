import numpy as np

from vigil.llm import topk as T

ROWS = "vec_id long, embedding array<float>, score int"


def brute(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 20 == 0:
            scored = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def made(n, d, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate((rng.normal(size=(n, d)) * 0.3).astype(np.float32))]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "SOME_ROWS", 50)
    monkeypatch.setattr(T, "SOME_QUERIES", 3)
    rows = made(230, 8, 1)
    rows += [(300 + i, rows[40][1]) for i in range(60)]  # ties beyond k
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    rows += [(420, [0.5, -0.5]), (421, [0.25, 0.1]), (440, []), (441, []), (460, [0.0] * 8), (461, [1000.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROWS).repartition(3)
    assert sorted(tuple(r) for r in T.twentieth(df).collect()) == brute(rows)
    monkeypatch.setattr(T, "SOME_QUERIES", 1)
    assert sorted(tuple(r) for r in T.twentieth(df).collect()) == brute(rows)


def test_repeated_ids(spark):
    rows = made(45, 4, 2)
    rows += [(20, rows[20][1]), (7, rows[7][1])]
    got = sorted(tuple(r) for r in T.twentieth(spark.createDataFrame([(*r, 1) for r in rows], ROWS)).collect())
    assert got == brute(rows)


def test_large_values_stay_exact():
    rng = np.random.default_rng(3)
    for size in (2**10, 2**22, 2**27):
        q, v = rng.integers(-size, size, (5, 16)).astype(float), rng.integers(-size, size, (300, 16)).astype(float)
        a, b, s = T.block_top(q, v, 4, np.full(5, -np.inf))
        exact = q.astype(np.int64) @ v.astype(np.int64).T
        assert (exact[a, b] == s).all()
        for i in range(5):
            assert set(np.argsort(-exact[i])[:4]) <= set(b[a == i])


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert T.twentieth(df).count() == 0
    assert T.twentieth(spark.createDataFrame([(20, [1.0], 0)], ROWS)).count() == 0


def test_reading_stops_early_where_vectors_are_clustered():
    rng = np.random.default_rng(5)
    centres = rng.integers(-40, 40, (200, 32)) * (rng.random((200, 32)) < 0.1)
    rows = (centres[np.arange(4000) % 200] * 3 + rng.integers(-1, 2, (4000, 32))).astype(float)
    queries, read = rows[:50], []
    a, b, s = T.block_top(queries, rows, 5, np.full(50, -np.inf), read)
    exact = queries @ rows.T
    assert (exact[a, b] == s).all() and all(set(np.argsort(-exact[i])[:1]) <= set(b[a == i]) for i in range(50))
    assert read[0] < 0.9 * 50 * rows.size
