import random

import numpy as np
import pytest

from capturelake.llm import joins
from capturelake.llm import near_duplicates as nd
from capturelake.llm.components import components


def brute(rows, width, percent):
    """{doc index: (size, least doc_id reachable)}; rows: (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [(len(s), min(d for k, (d, _) in enumerate(rows) if group[k] == group[i])) for i, s in enumerate(sets)]


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        else:
            t = " ".join(rng.choices(words, k=rng.choice([2, 10, 60, 150])))
        rows.append((i, t.title() if rng.random() < 0.2 else t))
    passage = " ".join(rng.choices(words, k=50))
    rows += [(n + k, passage + " " + " ".join(rng.choices(words, k=k % 40))) for k in range(80)]
    return rows


@pytest.mark.parametrize(("width", "percent", "most", "heads", "share"), [(3, 85, 1_000_000, 8, 1000), (5, 80, 3_000, 8, 20), (3, 85, 1_000, 1, 100)])
def test_equals_all_pairs(spark, monkeypatch, width, percent, most, heads, share):
    monkeypatch.setattr(nd, "CLUSTER_ELEMENTS", most)
    monkeypatch.setattr(nd, "HEADS", heads)
    monkeypatch.setattr(joins, "SHARE", share)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    want = {d: (n, c, c == d) for (d, _), (n, c) in zip(rows, brute(rows, width, percent), strict=True)}
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "one two three"), (6, "one two three"), (None, "one two three"), (7, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, "a", 0) for i, t in rows], "doc_id long, text string, print string, bands int")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs, 3, 85).collect()))
    assert got == [(-1, 1, 6, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True)]
    kept = nd.deduplicated(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]


def test_near_copies_with_null_ids(spark, monkeypatch):
    monkeypatch.setattr(nd, "CLUSTER_ELEMENTS", 500)
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join([*words[:i], "x", *words[i + 1 :]])) for i in range(0, 60, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(docs, 3, 85).collect()
    assert len(got) == 60 and all(r.component_id is None and r.kept and r.n_shingles == 58 for r in got)
    assert nd.deduplicated(docs, 3, 85).count() == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(docs).collect() == [] and nd.deduplicated(docs).collect() == []


def test_permutations_and_shifts():
    x = np.arange(200_000, dtype=np.uint32)
    assert len(np.unique(nd._permute(x.copy()))) == len(x)
    own = np.sort(np.random.default_rng(0).integers(0, 2**63, 1500).astype(np.uint64))
    place = nd._permute((own * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32))
    want = [nd._permute(place + s).min() for s in nd._SHIFTS]
    assert nd.signature(own).tolist() == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 2**63, 500).astype(np.uint64)])
    same = (nd.signature(np.sort(a)) == nd.signature(np.sort(b))).mean()
    assert abs(same - 1500 / 2500) < 0.15


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: v for x, v in label.items() if any(x in e and e[0] != e[1] for e in edges)}
