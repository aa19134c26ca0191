import random

import numpy as np

from vigil.llm import quality as Q

DOCS = "doc_id long, text string, __w int"


def made(n, seed=5):
    rng = random.Random(seed)
    good, bad = [f"word{i}" for i in range(300)], [f"JUNK{i}!!" for i in range(60)]
    docs = [(i, " ".join(rng.choices(good if i % 4 else bad, k=rng.randint(20, 80))), 1) for i in range(n)]
    return docs, [(i, int(i % 4 > 0), 0) for i in range(0, n, 3)]


def test_buckets_against_plain_python():
    import pyarrow as pa

    from vigil.llm.common import text_slices

    texts = ["a b!! a", "", None, "ééé|x  y", "b!!"]
    [(at, data, offsets)] = list(text_slices(pa.array(texts)))
    bucket, row = Q.ngram_buckets(data, offsets)
    per = [sorted(bucket[row == i]) for i in range(5)]
    assert [len(x) for x in per] == [7, 0, 0, 7, 3] and not per[1]
    assert set(per[4]) <= set(per[0])  # the tokens b, !! and their pair
    for i in (0, 3):
        [(_, d, o)] = list(text_slices(pa.array([texts[i]])))
        assert sorted(Q.ngram_buckets(d, o)[0]) == per[i]


def test_kept_on_held_out(spark):
    docs, labels = made(600)
    docs += [(1000, None, 1), (1001, "", 1), (None, docs[1][1], 1), (5, docs[5][1], 1), (5, docs[5][1], 1), (1002, "word1 " * 30000, 1)]
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = Q.resample(df, lab).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3]
    assert all(r.kept == (r.doc_id % 4 > 0) for r in held)
    assert len({r.kept for r in got if r.doc_id == 5}) == 1
    kept = Q.keep(df.drop("__w"), lab)
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(r.kept for r in got)


def test_kth_and_small_tables(spark):
    rng = np.random.default_rng(1)
    xs = [float(x) for x in np.concatenate([rng.normal(size=500) * 1e3, np.repeat(-2.5, 30), [0.0, -0.0]])]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 2, 250, 400, len(xs)):
        assert Q.kth_largest(df, "x", k) == sorted(xs, reverse=True)[k - 1]
    docs, labels = made(8)
    df, lab = spark.createDataFrame(docs, DOCS).drop("__w"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert Q.keep(df.limit(0), lab).count() == 0
    assert Q.keep(df, lab.limit(0)).count() == 8
    assert [r.kept for r in Q.resample(df, lab, k=3).orderBy("key").collect()] == [False] * 5 + [True] * 3


def test_level_is_the_lowest_that_does_as_well():
    scored = [(-100.0 - i, False) for i in range(100)] + [(float(i), True) for i in range(200)]
    assert -102 < Q.level(scored) < 0
    assert Q.level(scored + [(3.5, False)]) < 0 and Q.level([(1.0, True)]) == float("-inf") and Q.level([]) == float("-inf") and Q.level([(1.0, False)]) == float("inf")


def test_the_draw_is_in_proportion_to_the_weights(spark):
    """How often each of ten documents is among the four drawn, over 4000 seeds, against drawing one after the other in plain Python."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = [0.0, 0.0, -0.5, -1.0, -1.0, -2.0, -3.0, -5.0, 1.0, 2.0]
    docs = spark.createDataFrame([(i, f"t{i}", x) for i, x in enumerate(w)], "i long, t string, w double")
    keys = docs.crossJoin(spark.range(4000).withColumnRenamed("id", "seed")).withColumn("key", F.col("w") + Q.TEMPERATURE * Q.gumbel("i", "t", F.col("seed")))
    first = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("key")))
    got = dict(keys.withColumn("n", first).where("n <= 4").groupBy("i").count().collect())
    rng, want = random.Random(1), [0] * len(w)
    for _ in range(4000):
        left = dict(enumerate(np.exp(w)))
        for _ in range(4):
            [i] = rng.choices(list(left), list(left.values()))
            want[i] += 1
            del left[i]
    assert all(abs(got.get(i, 0) - want[i]) < 5 * np.sqrt(2 * 4000 * 0.25) for i in range(len(w)))
    assert len({got.get(i, 0) > 3900 for i in range(len(w))}) == 2 and 200 < got[5] < 3000  # the noise decides some of them


def test_weights_against_plain_python(spark):
    docs, labels = made(400, 6)
    df = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = Q.labelled_sample(lab)
    chosen = {r["__id"] for r in sample.collect() if r.good and r.fitted}
    grams = {i: [(x,) for x in parts] + list(zip(parts, parts[1:], strict=False)) for i, t, _ in docs for parts in [[y for x in t.split() for y in ([x] if x[-1] != "!" else [x[:-2], "!!"])]]}
    raw, target = {}, {}
    for i, gs in grams.items():
        for g in gs:
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + (i in chosen)
    part = sum(target.values()) / sum(raw.values())
    ratio = {g: np.log((target[g] + Q.PRIOR) / (n * part + Q.PRIOR)) if abs(target[g] - n * part) >= Q.EVIDENCE * np.sqrt(n * part + 1) else 0.0 for g, n in raw.items()}
    got = {r.doc_id: r for r in Q.resample(df, lab).collect()}
    close = sum(abs(got[i].log_weight - sum(ratio[g] for g in gs)) < 1e-3 + 1e-5 * len(gs) for i, gs in grams.items())
    assert close >= 0.95 * len(grams) and all(got[i].n_ngrams == len(gs) for i, gs in grams.items())  # but where two n-grams share a bucket
    fitted = {r["__id"] for r in sample.collect() if r.fitted}
    least = Q.level([(got[i].log_weight, bool(q)) for i, q, _ in labels if i not in fitted])
    assert sum(r.kept for r in got.values()) == sum(r.log_weight > least for r in got.values())


def test_toxic_documents_are_no_target(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices([f"word{j}" for j in range(200)], k=60) + (["vileword"] * 3 if i % 9 == 0 else [])), 1) for i in range(2000)]
    lab = spark.createDataFrame([(i, 1 if i % 50 else 0, int(i % 9 == 0)) for i in range(0, 2000, 2)], "doc_id long, quality int, toxic int")
    got = Q.resample(spark.createDataFrame(docs, DOCS), lab).collect()
    other = [r for r in got if r.doc_id % 2]
    assert sum(r.kept for r in other if r.doc_id % 9 == 0) <= 0.05 * sum(r.doc_id % 9 == 0 for r in other)
    assert sum(r.kept for r in other if r.doc_id % 9) >= 0.99 * sum(r.doc_id % 9 > 0 for r in other)
