import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from vigil.llm import packed_ids as K

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("size", [0, 1, 2, 4095, 4096, 4097, 20000])
def test_round_trip(size):
    rng = np.random.default_rng(size)
    for ids in (rng.integers(0, 1 << 16, size), np.zeros(size, int), rng.zipf(1.3, size) % 49408, np.tile([7, 65535, 0, 9, 9], size)[:size]):
        data = K.pack(ids)
        assert (K.unpack(data) == ids).all() and len(K.unpack(data)) == size
    assert [len(x) for x in K.unpack_all([K.pack(np.arange(5)), b"", K.pack(np.arange(4100))])] == [5, 0, 4100]


def test_repetition_is_learned():
    ids = np.tile(np.random.default_rng(1).integers(0, 49408, 50), 400)
    assert len(K.pack(ids)) < 0.25 * 2 * len(ids)


def test_damage_is_found():
    data = bytearray(K.pack(np.arange(6000) % 999))
    for at in (0, 9, 30, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            K.unpack(bytes(bad))
    with pytest.raises(ValueError):
        K.unpack(bytes(data[:-2]))
    with pytest.raises(ValueError):
        K.pack(np.array([70000]))


def test_pieces_as_the_library():
    texts = ["", "  A b\n\tC  ", "don't DON'T 'LL", "é é ếx", "日本語 テキスト🙂", "x<|endoftext|>y <|startoftext|>", "a\x0bb\x0cc\x1cd\x85e\xa0f g", "ΑΣ Σ ΣΣ. İI", "1234 5,6", "ﬁ ½ Å", "q" * 3000, "\r\n" * 5]
    want = [e.ids + [2] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in K.Tokens(PATH).encode(texts, 2)] == want
    assert [np.frombuffer(x, "<u2").tolist() for x in K.Tokens(PATH, K.ranks(PATH)).encode(texts, 2)] == want


def test_words_merged_here_as_the_library():
    rng = random.Random(3)
    letters = "aàbcdeéfghiïjklmnñoöpqrstuüvwxyzßþÿŁłŞŉſĸ" * 2 + "ABÇÉÎØŻ" + "0123'.,-!?*/\\\"#~\x7f\x03\x1c\u0130\u00d7\u0301Ωж"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(300)) for _ in range(40)]
    texts += [f"{a}'{b} {b}{a}'" for a in ("it", "don", "x") for b in ("s", "t", "re", "ve", "m", "ll", "d", "sx", "LL")] + ["the quick brown fox " * 9, None, "\x01a \x00 \x02", "\n\t "]
    merged = K.Tokens(PATH, K.ranks(PATH))
    assert merged.merge is not None
    want = [e.ids + [2] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in merged.encode(texts, 2)] == want
    pieces = [K.ranks(P.path("byte_bpe_50k.json"))]  # another kind of tokenizer
    assert pieces == [None]


def test_smaller_than_zlib_and_than_order_0_on_documents():
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    texts = pq.read_table(path, columns=["text"]).column("text").combine_chunks()
    ids, _ = K.Tokens(PATH, K.ranks(PATH)).encode_all(texts, 2)
    packed = K.pack(ids)
    share = np.bincount(ids) / len(ids)
    order0 = -(share[share > 0] * np.log2(share[share > 0])).sum() / 8
    assert (K.unpack(packed) == ids).all()
    assert len(packed) < len(zlib.compress(ids.astype("<u2").tobytes(), 9)) and len(packed) < order0 * len(ids)


def test_files(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    texts = [f"text number {i} " * (i % 7) for i in range(150)] + [None, "", "long words here " * 5000]
    rows = [(i * 3 % 151, t, 1) for i, t in enumerate(texts)] + [(None, "first", 1), (5, "again", 1), (5, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file int").repartition(5)
    files = K.write(df, PATH, partitions=4)
    got = sorted(K.digest(files).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(PATH)
    assert len(got) == len(rows)
    at, left = 0, list(rows)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        fit = next(x for x in left if x[0] == r.doc_id and r.ids_crc32 == zlib.crc32(np.array(tokenizer.encode(x[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()))
        left.remove(fit)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and not left
    ids = {r.start: r.ids for r in K.read(files).collect()}
    assert all(zlib.crc32(np.array(ids[r.start], "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert K.digest(K.write(df.limit(0), PATH)).count() == 0
