from collections import defaultdict

import numpy as np
import pytest

from capturelake.llm import mixing


def want_targets(sizes):
    """Targets by the plain rule: share what is left by weight, cut off at three times, again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total > 3 * sizes[s]}
        if not over:
            out |= {s: weight[s] * left / total for s in open_}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    return out


def rows(n=900):
    rng = np.random.default_rng(8)
    names = ["src0"] * 300 + ["b", "a", "é", "Z", None, "tiny"] * 100
    return [(i, " ".join("w" for _ in range(int(rng.integers(1, 60)))) if names[i] != "tiny" or i % 50 == 5 else "", names[i]) for i in range(n)]


@pytest.mark.parametrize("chunk", [4096, 40])
def test_targets_and_balance(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    data = rows()
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, source string, unit int")
    got = mixing.mixture(docs).collect()
    sizes, of = defaultdict(int), {}
    for i, t, s in data:
        of[i] = (s, len(t.split()))
        sizes[s] += of[i][1]
    want, taken = want_targets(sizes), defaultdict(int)
    assert len(got) == len(data)
    for r in got:
        s, size = of[r.doc_id]
        assert (r.size, r.source_size) == (size, sizes[s]) and r.target == pytest.approx(want[s])
        assert r.taken % max(1, size) == 0 and r.taken <= 3 * size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixture(docs).collect()), key=str)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(1, 500, 1000))[::-1]
    p = np.full(1000, 0.37)
    q = mixing.flight(p, x, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * x).sum() == pytest.approx((p * x).sum())


def test_inclusion_probabilities():
    x = np.array([9, 7, 5, 5, 3, 1, 1])
    mean = np.mean([mixing.flight(np.full(7, 0.4), x, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.allclose(mean, 0.4, atol=0.04)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "a b", "s"), (2, "", "s"), (3, "a b c", "t"), (3, "a b c", "t")], "doc_id long, text string, source string")
    got = mixing.mixture(docs).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r.size for r in got)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mixture(docs.limit(0)).collect() == [] and mixing.mixed_rows(docs.limit(0)).collect() == []


def test_flight_keeps_rows_and_words():
    rng = np.random.default_rng(5)
    rows, p = rng.integers(1, 6, 300), rng.random(300)
    words = rows * rng.integers(1, 900, 300)
    out = mixing.flight(p, words, rng, rows)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs((out - p) @ rows) < 1e-6 and abs((out - p) @ words) < 1e-4
