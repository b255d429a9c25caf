import random
import zlib

import numpy as np
import pytest

from capturelake.llm import token_files as tf

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(tf.default_tokenizer())


def each(encode, texts):
    ids, sizes = encode(texts)
    assert len(sizes) == len(texts) and sizes.sum() == len(ids)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(plain):
    rng = random.Random(5)
    bits = ["a", "The", "don't", "I'll", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "\u0085", "\x1c", ".", ",", "!?", "###", "'", "'s", "42", "3.5", "é", "ß", "日本", "語", "😀", "é", "<|endoftext|>", "#", "_", "-", "²", "word.", "end.\nNext", "x,\ny"]
    texts = ["", " ", "\n", " a", "a ", "\tfoo bar", "foo\n bar", "foo \n bar", "foo.\n\nBar baz", *("".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(3000))]
    got = tf.Encoder(tf.default_tokenizer())
    for part in (texts, list(reversed(texts)), texts[:1]):
        for t, ids in zip(part, each(got, part), strict=True):
            assert ids == ids_of(plain, t), repr(t)


def test_full_memory_gives_the_same(plain, monkeypatch):
    monkeypatch.setattr(tf, "CACHE_WORDS", 3)
    got = tf.Encoder(tf.default_tokenizer())
    texts = ["one two three four.", "five six one two", "four. seven\nEight nine"]
    for _ in range(2):
        assert each(got, texts) == [ids_of(plain, t) for t in texts]


def test_long_texts_in_pieces(plain, monkeypatch):
    monkeypatch.setattr(tf, "SLICE", 40)
    texts = ["", "one two, three\nfour five " * 9 + "six", "short one", "x" * 100, "a b", "\ttab first " * 20 + ".", ""]
    assert each(tf.Encoder(tf.default_tokenizer()), texts) == [ids_of(plain, t) for t in texts]


def test_round_trip(spark, plain, tmp_path):
    rows = [(5, "hello world " * 400), (1, None), (2, ""), (None, "null id"), (5, "again"), (5, "again"), (9, "last # one")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    out = f"file://{tmp_path}/t"
    parts = tf.write_token_files(docs, out, seq_len=16)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tf.read_token_files(spark, out, parts).collect())
    want, at = {}, 0
    for i, t in rows:
        ids = [*ids_of(plain, t), 2]
        want.setdefault((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), 0)
    assert {(d, n, c) for _, d, n, c in got} == set(want) and len(got) == len(rows)
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [d for _, d, _, _ in got] == [None, 1, 2, 5, 5, 5, 9]
    first = tf.SequenceFile(f"{out}/part-{parts[0][0]:06d}.arrow")
    ids, mask = first[0]
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata
    total = sum(sum(m.to_pylist()) for m in (first[i][1] for i in range(len(first))))
    assert total == parts[0][2]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.token_files(docs, f"file://{tmp_path}/e").collect() == []
