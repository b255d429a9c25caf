import zlib
from collections import Counter

import pytest

from capturelake.llm import language as lg

TEXT = {
    "en": "the quick brown fox and the lazy dog are with that other thing in the house of this town ",
    "de": "der schnelle braune Fuchs und der faule Hund sind mit diesem anderen Ding im Haus der Stadt ",
    "fr": "le renard brun rapide et le chien paresseux sont avec cette autre chose dans la maison de la ville ",
}


def slow_profile(text):
    """Most frequent n-grams by counting strings."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    c = Counter()
    for w in words:
        padded = f" {w} "
        c.update(w)
    joined = " " + " ".join(words) + " "
    c.update(joined[i : i + 2] for i in range(len(joined) - 1))
    c.update(t for i in range(len(joined) - 2) if (t := joined[i : i + 3])[1] != " ")
    code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
    return [g for g, _ in sorted(((code(g), n) for g, n in c.items()), key=lambda x: (-x[1], x[0]))][: lg.TOP]


@pytest.mark.parametrize("text", ["a", "Hello, hello world!", "don't  stop—né 42 x", TEXT["de"] * 3, "日本 語"])
def test_profile_equals_counting(text):
    assert lg.profile(text).tolist() == slow_profile(text)


def test_distance_by_definition():
    model = lg.RankOrder({"x": [5, 3, 9], "y": [3, 5]})
    assert model.langs == ["x", "y"]
    ranks = {k: lg.profile(t).tolist() for k, t in TEXT.items()}
    model = lg.RankOrder(ranks)
    own = lg.profile("the dog in this house").tolist()
    d = {k: sum(abs(i - r.index(g)) if g in r else lg.TOP for i, g in enumerate(own)) for k, r in ranks.items()}
    best = min(sorted(d), key=d.get)
    second = min(v for k, v in d.items() if k != best)
    assert model("the dog in this house") == (best, pytest.approx((second - d[best]) / second))


def docs_of(spark):
    rows = [(i, TEXT[k] * (1 + i % 3), k, 0) for i, k in enumerate(["en", "de", "fr"] * 40)]
    rows += [(200, None, "en", 0), (201, "12 34 !!", "de", 0), (202, "", None, 0), (None, TEXT["fr"], None, 0), (203, TEXT["en"] * 3000, None, 0), (203, TEXT["en"] * 3000, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_predictions(spark):
    docs = docs_of(spark)
    got = lg.languages_of(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id in (200, 201, 202):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id is not None and r.doc_id < 200:
            assert r.lang_pred == ("en", "de", "fr")[r.doc_id % 3]
        else:
            assert r.lang_pred == ("fr" if r.doc_id is None else "en")
    kept = lg.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert lg.languages_of(docs).first().lang_pred == "und"
    assert lg.languages_of(docs.limit(0)).collect() == []
