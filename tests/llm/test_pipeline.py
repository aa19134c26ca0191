import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline as C
from vigil.llm import bpe
from vigil.llm.common import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `__id` long, `row` string, w double"


def made():
    rng = random.Random(12)
    words = {"en": [f"the{i}" for i in range(150)], "de": [f"über{i}ß" for i in range(150)]}
    prose = lambda lang, n=80: " ".join(rng.choices(words[lang], k=n))
    docs = [(i, prose("en" if i % 3 else "de")) for i in range(300)]
    junk = [(1000 + i, " ".join(f"{rng.choice('abc')}$$$ ###" for _ in range(60))) for i in range(60)]
    items = [(k, prose("en", 40)) for k in range(3)]
    dirty = [(2000 + k, prose("en", 10) + " " + items[k % 3][1] + " " + prose("en", 10)) for k in range(6)]
    copies = [(3000 + i, "".join(c.upper() if c.isascii() else c for c in docs[i][1]) if i % 2 else docs[i][1] + " end") for i in range(0, 40)]
    odd = [(4000, None), (4001, ""), (4002, "  \n"), (4003, "12 34 !!"), (5, docs[5][1]), (5, docs[5][1]), (None, prose("en")), (4004, prose("en", 30000))]
    rows = docs + junk + dirty + copies + odd
    rng.shuffle(rows)
    langs = {**{i: "en" if i % 3 else "de" for i in range(300)}, **{r[0]: "en" for r in dirty}}
    return [(i, t, langs.get(i), "s", len(t or ""), 1, "x", 0.5) for i, t in rows], [(i, int(i < 1000), 0) for i in [*range(0, 300, 2), *range(1000, 1060, 2)]] + [(None, 1, 0), (7, None, None)], items


def test_stages_and_run(spark, tmp_path):
    docs, labels, items = made()
    d = str(tmp_path)
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    left, columns = spark.read.parquet(f"{d}/documents.parquet"), None
    kept = []
    for name, stage in C.STAGES[:-1]:
        columns = columns or left.columns
        left = stored(stage(spark, left, d), "test")
        assert left.columns == columns, name
        kept.append(sorted(r.doc_id if r.doc_id is not None else -1 for r in left.select("doc_id").collect()))
    quality, language, single, clean = map(set, kept)
    assert not any(1000 <= i < 1060 for i in quality) and len(quality & set(range(300))) >= 298
    assert language == quality - {4000, 4001, 4002, 4003}
    assert single == {i for i in language if not 3000 <= i < 3040} and len(kept[2]) == len(single)
    assert clean == {i for i in single if not 2000 <= i < 2006}
    texts = {i: t for i, t, *_ in docs}
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in C.run(spark, d).collect()}
    assert {i if i is not None else -1 for i in got} == clean
    for i in sorted(x for x in clean if x >= 0)[:40]:
        assert got[i].n_tokens == len(coder.encode_ordinary(texts[i])) and got[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    docs, _, _ = made()
    for name, rows in (("none", []), ("some", docs[:30])):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/{name}/benchmark.parquet")
    assert C.run(spark, f"{d}/none").count() == 0
    assert C.run(spark, f"{d}/some").count() > 0
