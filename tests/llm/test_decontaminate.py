import hashlib
import random
import re

import pytest

from vigil.llm import decontaminate as D

DOCS = "doc_id long, text string, win string, items int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, own in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= {str(x) for x in own if x is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("broadcast", [D.BROADCAST_BYTES, -1])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_BYTES", broadcast)
    rng = random.Random(3)
    vocab = ["Aa", "b", "cé", "d", "ee-f"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 13, 14, 20])) if i > 1 else ["zz", "Yy", str(i)])) for i in range(12)] + [(None, "q r s"), (77, None), (2, "q r s")]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(40)]
    docs += [(200 + i, "the same thirteen words are in every one of these texts here now " * 30 + str(i)) for i in range(30)]  # a hot window
    items.append((8, "The same thirteen words are in every one of these texts here now"))
    docs += [(90, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (None, "x Q r! S x"), (91, None), (92, ""), (93, items[9][1] + ". " + "w " * 5000), (94, "ZZ yy 1 " * 3000), (3, "other text")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in D.digest(D.hits(df, bench)).collect()]
    assert key(got) == key(brute(docs, items))


def test_beyond_broadcast_no_words_go_with_the_windows(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    docs = spark.createDataFrame([(1, "a b c " * 50, "", 0)], DOCS)
    plan = D.hits(docs, spark.createDataFrame([(5, "b c")], "item_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    # the innermost join, of windows by their hash
    join = next(line for line in reversed(plan.splitlines()) if "Join Inner" in line and "(h#" in line)
    below = plan.splitlines()[plan.splitlines().index(join) + 1]
    assert "Project" in below and "ws#" not in below, below


def test_empty_tables_and_join_beyond_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c", "", 0)], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in D.digest(D.hits(docs, none)).collect()] == [(3, 0, 0)]
    assert D.digest(D.hits(docs.limit(0), none)).count() == 0
    monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    bench = spark.createDataFrame([(5, "b c")], "item_id long, text string")
    assert [tuple(r)[1:4] for r in D.digest(D.hits(docs, bench)).collect()] == [(3, 2, 1)]


def test_removal(spark):
    docs = spark.createDataFrame([(1, "keep This, b c. End", "", 0), (2, None, "", 0), (3, "b-c", "", 0)], DOCS)
    bench = spark.createDataFrame([(5, "b c")], "item_id long, text string")
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, bench).collect()}
    assert cut == {1: "keep This. End", 2: None, 3: ""}
    left = D.remove_documents(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]


def test_stages_survive_any_column_name(spark):
    rows = [(1, "x y b c d", "h", "s", "p"), (2, None, None, None, None), (None, "b c", "h", "s", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__hash` string, `__spans` string, `__parts` string").withColumnsRenamed({}).selectExpr("*", "1 as `__id`", "2 as id", "3 as spans", "4 as `a.b`", "'t' as tail")
    bench = spark.createDataFrame([(5, "b c")], "item_id long, text string")
    left = D.remove_documents(df, bench)
    assert left.columns == df.columns and [r.doc_id for r in left.collect()] == [2]
    cut = D.remove_spans(df, bench)
    assert cut.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in cut.collect() if r.text is not None) == [(0, ""), (1, "x y d")]
