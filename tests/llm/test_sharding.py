import zlib
from collections import Counter

import numpy as np
import pytest

from capturelake.llm import sharding


@pytest.mark.parametrize("n", [0, 1, 15, 1003])
def test_exact_sizes(spark, monkeypatch, n):
    monkeypatch.setattr(sharding, "PART_ROWS", 20)
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "é" * (i % 5), 3) for i in range(n)], "doc_id long, text string, slot int")
    rows = sharding.shards_of(docs).collect()
    assert len(rows) == n and {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values(), default=0) - min((counts[s] for s in range(16)), default=0) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        data = ("" if r.doc_id % 7 == 0 else "é" * (r.doc_id % 5)).encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    again = sharding.shards_of(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_nulls_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a")] * 5 + [(1, None)] * 5, "doc_id long, text string")
    rows = sharding.shards_of(docs, n_shards=3).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [3, 3, 4]


def test_matrix_sums_and_law():
    parts, shards = [5, 0, 12, 3], [7, 7, 6]
    total = np.zeros((4, 3))
    for seed in range(3000):
        m = np.array(sharding.communication_matrix(parts, shards, seed))
        assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == shards and (m >= 0).all()
        total += m
    assert np.allclose(total / 3000, np.outer(parts, shards) / 20, atol=0.15)


def test_large_populations_keep_the_law(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_MOST", 0)
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 30, 50, 20) for _ in range(20_000)]
    want = np.random.default_rng(2).hypergeometric(30, 50, 20, 20_000)
    assert abs(np.mean(draws) - 7.5) < 0.05 and abs(np.std(draws) - np.std(want)) < 0.05
    monkeypatch.undo()
    k = sharding.hypergeometric(rng, 10**11, 3 * 10**11, 10**6)
    assert abs(k - 250_000) < 5_000


def test_positions_are_spread(spark):
    rows = sharding.shards_of(spark.range(4000).selectExpr("id as doc_id", "'t' as text"), n_shards=4).collect()
    early = np.mean([r.doc_id < 2000 for r in rows if r.slot < 500])
    assert abs(early - 0.5) < 0.06
