import numpy as np
import pytest

from vigil.llm import setjoin as S

from .test_neardup import made, shingles

DOCS = "doc_id long, text string, id long, grp int"


def brute(docs, k, h):
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
                if 100 * both >= h * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(docs[i][0]), find(docs[j][0])))
                    root[b] = a
    return sorted(repr((d[0], len(s), None if d[0] is None else find(d[0]))) for d, s in zip(docs, sets, strict=True))


def got(spark, docs, **how):
    return sorted(repr(tuple(r)) for r in S.classes(spark.createDataFrame(docs, DOCS).repartition(3), **how).collect())


@pytest.mark.parametrize("k, t", [(3, 0.9), (2, 0.7)])
def test_against_brute_force(spark, monkeypatch, k, t):
    monkeypatch.setattr(S, "BLOCK", 4)  # so that blocks meet
    docs = made(seed=9)
    assert got(spark, docs, words=k, threshold=t) == brute(docs, k, round(100 * t))


def test_chain_without_a_hub(spark, monkeypatch):
    """Each text is linked with the next two only: stars leave groups open, trees find the rest."""
    monkeypatch.setattr(S, "BLOCK", 8)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(40):
        docs.append((100 - i, " ".join(words), 0, 0))
        for k in range(3):
            words[(i * 9 + 60 * k) % 200] = f"x{i}-{k}"
    assert got(spark, docs) == brute(docs, 3, 90)


def test_empty(spark):
    assert S.classes(spark.createDataFrame([], DOCS)).collect() == []


def test_walk_prunes_and_loses_nothing():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in rng.integers(300, 400, 600)]
    for i in range(0, 600, 6):  # near copies, of which each sixth is far from its neighbours
        sets[i + 1] = np.unique(np.concatenate([sets[i][3:], rng.integers(0, 1 << 62, 2, dtype=np.uint64)]))
    bits = np.array([np.frombuffer(S.bitmap(s), np.uint64) for s in sets])
    n = np.array([len(s) for s in sets])
    ids = np.arange(600)
    tree = S.Tree(ids, ids.copy(), n, bits)
    a, b, looked = S.walk(tree, tree, 90)
    met = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    true = {(i, j) for i in range(600) for j in range(i + 1, 600) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (n[i] + n[j] - both)}
    assert true <= met and len(met) <= len(true) + 10 and looked < 600 * 599 / 2 / 2
    one, other = S.Tree(ids[:300], ids[:300], n[:300], bits[:300]), S.Tree(ids[300:], ids[300:], n[300:], bits[300:])
    found = {tuple(x) for part in (S.walk(one, one, 90), S.walk(other, other, 90), S.walk(one, other, 90)) for x in zip(np.minimum(part[0], part[1]).tolist(), np.maximum(part[0], part[1]).tolist(), strict=True)}
    assert found == met
    # members of one component don't meet
    assert len(S.walk(t := S.Tree(ids, np.zeros(600, np.int64), n, bits), t, 90)[0]) == 0


def test_a_prefix_holds_a_common_shingle():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 10, 11, 150):
        base = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        for gone in range(n):
            other = base[gone:]
            if 100 * len(other) >= 90 * len(base):
                assert set(np.sort(base)[: S.prefix_length(len(base), 90)]) & set(np.sort(other)[: S.prefix_length(len(other), 90)])
