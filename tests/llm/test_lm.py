import collections
import random
import re
import zlib

import numpy as np

from vigil.llm import lm

DOCS = "doc_id long, text string, score int, h long"


def made(n, seed=1):
    rng = random.Random(seed)
    langs = [[f"{p}{i}" for i in range(40)] for p in "abc"]
    return [(i, " ".join(rng.choices(langs[i % 3], k=rng.randint(1, 60))) + (f"\tRare{i}" if i % 5 == 0 else ""), 0, 1) for i in range(n)]


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", low) if x] + ["<END>"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_base_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 60)  # so that most words come by the join
    docs = made(120) + [(900, None, 0, 1), (901, " \n", 0, 1), (None, "a1 zz", 0, 1), (902, "a1 b2 " * 20000, 0, 1), (5, "zz", 0, 1), (5, "zz", 0, 1)]
    got = lm.score(spark.createDataFrame(docs, DOCS).repartition(3)).collect()
    counts = collections.Counter(t for i, x, *_ in docs if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, x, *_ in docs:
        ts = tokens(x)
        want.append((i, held(i), len(ts), sum(counts[t] > 0 for t in ts), n, round(float(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in ts)), 4)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))) for r in got)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_learns(spark):
    docs = made(3000, 2)
    got = [r for r in lm.score(spark.createDataFrame(docs, DOCS).coalesce(2)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_the_network_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)
    docs = made(3000, 7) + [(5000, "a1 b2 c3 " * 3000, 0, 1), (None, None, 0, 1), (None, None, 0, 1)]
    df = spark.createDataFrame(docs, DOCS)
    one, eight = ({(r.doc_id, round(r.base_score, 6)): r.score for r in lm.score(df.repartition(n)).collect()} for n in (1, 8))
    assert one.keys() == eight.keys() and all(abs(one[k] - eight[k]) <= 1e-3 * abs(one[k]) for k in one)


def test_rounds_of_averaging_learn_more_than_one(monkeypatch):
    """Two shards, in one round and in three, of a language in which the word before tells the next: more is learned in three."""
    rng = random.Random(4)
    words = lm.Words(np.array([int(lm.END), *range(1, 60)], np.uint64), np.arange(60, 0, -1))
    texts = []
    for _ in range(900):
        at, out = rng.randrange(1, 60), []
        for _ in range(60):
            out.append(at)
            at = 1 + (at * 7 + rng.randrange(2)) % 59
        texts.append(out)

    def tokens(some):
        return np.array([x for t in some for x in [*t, 0]]), np.arange(len(some) + 1) * 61

    def learned(rounds):
        net, seen = lm.initial(words, 60_000), None
        for r in range(rounds):
            made = [lm.Trainer(net, seen) for _ in range(2)]
            for k, trainer in enumerate(made):
                trainer.read(*tokens(texts[k : 800 : 2][r::rounds]), words.end)
            net, seen = ({k: sum(x[k] for x in parts) / 2 for k in parts[0]} for parts in ([t.p for t in made], [t.squares() for t in made]))
        return lm.score_tokens(net, *tokens(texts[800:]), words.end).mean()

    assert learned(3) > learned(1) > lm.score_tokens(lm.initial(words, 60_000), *tokens(texts[800:]), words.end).mean()


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert lm.score(df).count() == 0
    only_held = next(i for i in range(100) if held(i))
    [r] = lm.score(spark.createDataFrame([(only_held, "x y", 0, 1)], DOCS)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and np.isfinite(r.score)


def small():
    rng = np.random.default_rng(0)
    words = lm.Words(np.concatenate([rng.integers(1, 1 << 62, 50).astype(np.uint64), [lm.END]]), np.arange(51, 0, -1))
    p = lm.initial(words, 2000)
    for k in ("Wc", "Ww"):
        p[k] = rng.normal(0, 0.3, p[k].shape).astype(np.float32)
    return words, p


def test_probabilities_sum_to_one():
    words, p = small()
    hs = np.random.default_rng(1).normal(size=(3, lm.HIDDEN)).astype(np.float32)
    ids = np.concatenate([np.arange(lm.VOCABULARY), [-1]])
    for h in hs:
        total = np.exp(lm.out_log_probs(p, np.repeat(h[None], len(ids), axis=0), ids)).sum()
        assert abs(total - 1) < 1e-3


def test_state_is_carried_whatever_the_streams(monkeypatch):
    words, p = small()
    rng = np.random.default_rng(2)
    sizes = [1, 700, 3, 40, 1, 90]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(-1, 51, starts[-1])
    plain = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        h, before = np.zeros((1, lm.HIDDEN), np.float32), words.end
        for i in range(a, b):
            h = lm.step(p, h, p["E"][[before if before >= 0 else lm.VOCABULARY]])[-1]
            plain.append(lm.out_log_probs(p, h, ids[i : i + 1])[0])
            before = ids[i]
    for lanes in (1, 2, 256):
        monkeypatch.setattr(lm, "LANES", lanes)
        monkeypatch.setattr(lm.streams, "__defaults__", (lanes,))
        assert np.allclose(lm.score_tokens(p, ids, starts, words.end), plain, atol=1e-3)


def test_gradient_against_differences(monkeypatch):
    words, p = small()
    rng = np.random.default_rng(3)
    ids = rng.integers(-1, 51, (4, 3))
    inputs = np.concatenate([np.full((1, 3), words.end), ids[:-1]])
    inputs = np.where(inputs < 0, lm.VOCABULARY, inputs)
    fresh = np.zeros((4, 3), bool)
    fresh[0] = fresh[2, 1] = True
    real = np.ones((4, 3), bool)
    real[3, 2] = False
    grads = {}
    monkeypatch.setattr(lm.Trainer, "update", lambda self, name, grad, rows=None: grads.__setitem__(name if rows is None or name == "E" else f"{name}{rows}", (grad.copy(), rows)))
    lm.Trainer(p).window(np.zeros((3, lm.HIDDEN), np.float32), inputs, fresh, ids, real)

    def loss(q):
        h, total = np.zeros((3, lm.HIDDEN)), 0.0
        for t in range(4):
            h = np.where(fresh[t][:, None], 0, h)
            h = lm.step(q, h, q["E"][inputs[t]])[-1]
            total -= lm.out_log_probs(q, h[real[t]], ids[t][real[t]]).sum()
        return 0.02 * total

    q = {k: v.astype(np.float64) for k, v in p.items()}
    for name, spots in (("U", [(0, 0), (5, 30), (7, 40)]), ("E", [(int(inputs[1, 0]), 3), (words.end, 40)]), ("Wc", [(2, 0), (3, lm.CLASSES)])):
        for spot in spots:
            up, down = ({**q, name: q[name].copy()} for _ in "ab")
            up[name][spot] += 1e-4
            down[name][spot] -= 1e-4
            grad, rows = grads[name]
            at = spot if rows is None else (int(np.flatnonzero(rows == spot[0])[0]), spot[1])
            assert abs(grad[at] - (loss(up) - loss(down)) / 2e-4) < 2e-4


def test_the_network_is_whole():
    assert (lm.HIDDEN, lm.WINDOW, lm.RATE) == (24, 16, 0.15)
    _, p = small()
    assert p["U"].shape == (24, 72) and p["E"].shape == (lm.VOCABULARY + 1, 72) and p["Ww"].shape == (lm.CLASSES, 24, lm.SIZE)


def test_an_update_a_window_of_sixteen(monkeypatch):
    words, p = small()
    steps = []
    monkeypatch.setattr(lm.Trainer, "window", lambda self, h, inputs, *more: steps.append(len(inputs)) or h)
    lm.Trainer(p).read(np.zeros(320, np.int64), np.array([0, 320]), words.end)
    assert steps == [16] * 20


def test_words_with_structure_are_counted_apart(spark):
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    x, y = ("".join(p[b] for b in bits) for p in ("ab", "ba"))
    train = [i for i in range(100) if not held(i)][:2]
    other = next(i for i in range(100) if held(i))
    docs = [(train[0], f"{x} q", 0, 1), (train[1], f"{x} r", 0, 1), (other, f"{x} {y} {y} q", 0, 1)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[other].n_known == 3 and got[train[0]].train_tokens == 6
    n, v = 6, 4
    assert abs(got[other].base_score - float(sum(np.log10((c + 1) / (n + v + 1)) for c in (2, 0, 0, 1, 2)))) < 1e-9


def test_output_in_blocks(monkeypatch):
    words, p = small()
    rng = np.random.default_rng(5)
    p["bw"][:2] = rng.normal(0, 1, (2, lm.SIZE))
    made = {}
    monkeypatch.setattr(lm.Trainer, "update", lambda self, name, grad, rows=None: made.setdefault(lm.ROWS, {}).__setitem__(name, grad.copy()))
    for ids in (np.where(rng.random(300) < 0.2, -1, (rng.pareto(0.5, 300)).astype(np.int64) % lm.VOCABULARY), np.full(5, -1), np.arange(7)):
        made.clear()
        hs = rng.normal(0, 0.5, (len(ids), lm.HIDDEN)).astype(np.float32)
        logits, within = hs @ p["Wc"] + p["bc"], np.einsum("nh,nhs->ns", hs, p["Ww"][np.maximum(ids, 0) // lm.SIZE]) + p["bw"][np.maximum(ids, 0) // lm.SIZE]
        part = lambda x: x - np.log(np.exp(x.astype(np.float64)).sum(axis=1))[:, None]
        at, cls = np.arange(len(ids)), np.where(ids < 0, lm.CLASSES, ids // lm.SIZE)
        want = part(logits)[at, cls] + np.where(ids < 0, 0, part(np.maximum(within, -40))[at, ids % lm.SIZE])
        d, e = np.exp(part(logits)), np.where(ids[:, None] < 0, 0, np.exp(part(np.maximum(within, -40))))
        d[at, cls] -= 1
        e[at[ids >= 0], ids[ids >= 0] % lm.SIZE] -= 1
        back = 0.02 * (d @ p["Wc"].T + np.einsum("ns,nhs->nh", e, p["Ww"][np.maximum(ids, 0) // lm.SIZE]))
        for rows in (7, 64, 1024):
            monkeypatch.setattr(lm, "ROWS", rows)
            assert np.allclose(lm.out_log_probs(p, hs, ids), want, atol=1e-4)
            assert np.allclose(lm.Trainer(p).output(hs.copy(), ids), back, atol=1e-5)
        for name in ("Wc", "bc", "Ww", "bw"):
            assert all(np.allclose(made[7][name], made[n][name], atol=1e-5) for n in (64, 1024))
        assert np.allclose(made[7]["Wc"], 0.02 * hs.T @ d, atol=1e-5) and np.allclose(made[7]["bc"], 0.02 * d.sum(axis=0), atol=1e-5)
        assert np.allclose(made[7]["bw"][0], 0.02 * e[(ids >= 0) & (ids < lm.SIZE)].sum(axis=0), atol=1e-5)


def test_sums_of_equal_rows():
    rng = np.random.default_rng(6)
    for n in (1, 3, 50, 4000):
        rows = (rng.pareto(0.6, n) * 2).astype(np.int64) % (lm.VOCABULARY + 1)
        x = rng.normal(size=(n, 6)).astype(np.float32)
        got, of = lm.row_sums(x, rows)
        assert sorted(of.tolist()) == sorted(set(rows.tolist()))
        for total, row in zip(got, of, strict=True):
            assert np.allclose(total, x[rows == row].sum(axis=0), atol=1e-3)


def test_arrays_of_a_window_are_few():
    import tracemalloc

    words, p = small()
    ids = np.random.default_rng(7).integers(-1, lm.VOCABULARY, (lm.WINDOW, lm.LANES))
    inputs, none = np.where(ids < 0, lm.VOCABULARY, ids), np.zeros(ids.shape, bool)
    trainer = lm.Trainer(p)
    tracemalloc.start()
    trainer.window(np.zeros((lm.LANES, lm.HIDDEN), np.float32), inputs, none, ids, ~none)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10_500_000  # it was 11353493


def test_gates_lie_together():
    """Arithmetic over rows of 24 numbers with gaps took half of a step."""
    _, p = small()
    inputs = np.random.default_rng(8).integers(0, lm.VOCABULARY + 1, (2, 5))
    h = np.random.default_rng(9).normal(0, 0.3, (5, lm.HIDDEN)).astype(np.float32)
    parts = lm.step(p, h, p["E"][inputs[0]])
    assert all(x.flags.c_contiguous for x in parts)
    assert all((a == b).all() for a, b in zip(parts, lm.step(p, h, lm.gathered(p, inputs)[0]), strict=True))


def test_logits_are_clipped_only_where_any_can_be_beyond(monkeypatch):
    _, p = small()
    p["bw"] = np.maximum(p["bw"], -9)
    hs, ids = np.random.default_rng(10).uniform(-1, 1, (50, lm.HIDDEN)).astype(np.float32), np.arange(50) * 64
    calls, clip = [], np.clip
    monkeypatch.setattr(np, "clip", lambda *a, **k: calls.append(a) or clip(*a, **k))
    lm.out_log_probs(p, hs, ids)
    assert not calls
    for size in (1.5, 60.0):
        p["Ww"][3] = size
        got = lm.out_log_probs(p, np.ones_like(hs), np.full(50, 3 * 64))
        assert calls and np.isfinite(got).all() and np.allclose(got, got[0])
        calls.clear()
    logits = clip(np.ones(lm.HIDDEN) @ p["Ww"][3] + p["bw"][3], -40, 40)
    classes = p["bc"] + p["Wc"].sum(axis=0)
    assert np.isclose(got[0], logits[0] - np.log(np.exp(logits).sum()) + classes[3] - np.log(np.exp(classes.astype(float)).sum()), atol=1e-3)
