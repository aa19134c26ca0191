import gc
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from vigil.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a" * 20000, "ab" * 40, " " * 500, "\n\n \t x", "<|endoftext|> hi", "日本語テキスト🙂" * 50, "it's I'LL 're", "é" * 1001, "\x00\x1c\x1d\x85\xa0  x", "x" * 257 + "!" * 99]


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(PATH, P.PATTERN)


def test_encodes_as_the_library(coder):
    rng = random.Random(2)
    alphabet = "abcdeABC  .,!'\n\té中ß123 "
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(300)]
    want = reference()
    got = coder.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text)
    assert coder.decode(got) == [t.encode() for t in texts]


def test_every_letter_class_as_the_library(coder):
    want = reference()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 40000):
        text = "".join(f"a{chr(c)}1" for c in points[at : at + 40000 : 7])
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == want.encode_ordinary(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PIECES", 2)
    monkeypatch.setattr(bpe, "DECODED_IDS", 4)
    small, want = bpe.Coder(PATH, P.PATTERN), reference()
    for text in ("one two three four", "one five", "two six seven", "one two three four"):
        [ids] = small.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text) and small.decode([ids, b"", ids]) == [text.encode(), b"", text.encode()]
    with pytest.raises(ValueError):
        small.decode([np.array([60000], "<u4").tobytes()])


def test_queries(spark):
    docs = [(i, t, 1) for i, t in enumerate(ODD)] + [(3, None, 1), (None, "x y", 1), (3, "x y", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids int")
    want = reference()
    got = sorted(map(repr, map(tuple, bpe.round_trip(df, PATH, P.PATTERN).collect())))
    ids = {d: np.array(want.encode_ordinary(d), "<u4") for d in {t or "" for _, t, _ in docs}}
    assert got == sorted(repr((i, len(ids[t or ""]), hashlib.sha256(ids[t or ""].tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())) for i, t, _ in docs)
    coded = bpe.encode(df, PATH, P.PATTERN)
    assert sorted(repr((r.id, r.text)) for r in bpe.decode(coded, PATH, P.PATTERN).collect()) == sorted(repr((i, t or "")) for i, t, _ in docs)
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


def test_a_worker_keeps_nothing_between_tasks(spark, monkeypatch):
    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(isinstance(x, bpe.Coder) for x in gc.get_objects())]})

    rows = spark.createDataFrame([(i, f"one two {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    coded = bpe.encode(rows, PATH, P.PATTERN)
    for df in (bpe.round_trip(rows, PATH, P.PATTERN), coded, bpe.decode(coded, PATH, P.PATTERN)):
        assert df.count() == 40
        assert {r.n for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()} == {0}
    made = []
    monkeypatch.setattr(bpe, "Coder", lambda *a, kind=bpe.Coder: made.append(kind(*a)) or made[-1])
    with pytest.raises(KeyError), bpe.coder(PATH, P.PATTERN) as c:
        raise KeyError(c.encode(["x"])[0])
    assert not made[0].known
    with pytest.raises(Exception, match="(?i)closed"):
        made[0].encode(["y"])
