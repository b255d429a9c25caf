import random

import pytest

from archive import ids, library
from capturelake.operators import insights as n


def test_timelines(spark):
    lib = library(spark, [{"id": 1, "created_ts": 1787054400}, {"id": 2, "created_ts": 1787058000}, {"id": 3, "modified_ts": 1787227200}, {"id": 4, "created_ts": 1787227200, "status": "missing"}, {"id": 5}])
    months = n.timeline_months(lib.captures).collect()
    assert [(m.key, m["count"]) for m in months] == [("2026-08", 3)]
    days = n.timeline_days(lib.captures, 2026, 8).collect()
    assert sum(d["count"] for d in days) == 3
    assert ids(n.timeline_items(lib.captures, days[-1].date)) == [2, 1]
    for bad in (lambda: n.timeline_days(lib.captures, 2026, 13), lambda: n.timeline_items(lib.captures, "not-a-date")):
        with pytest.raises(ValueError):
            bad()
    assert n.timeline_months(lib.captures, "Asia/Tokyo").collect()[0]["count"] == 3


def burst_library(spark):
    b = 1787000000
    rows = [(1, 0, "chrome", "code"), (2, 300, "chrome", "code"), (3, 600, None, "code"), (4, 7200, "slack", "communication"), (5, 7500, "slack", None), (6, 500000, None, None)]
    return library(spark, [{"id": i, "created_ts": b + t, "app_name": a, "category": c, "content_hash": None if i == 2 else f"h{i}"} for i, t, a, c in rows], tags=[(1, "x"), (2, "x"), (2, "y"), (3, "z")])


def test_bursts(spark):
    lib = burst_library(spark)
    new, old = n.burst_themes(lib).collect()
    assert (new["count"], new.top_app, old["count"], old.top_app, old.top_category) == (2, "slack", 3, "chrome", "code")
    assert old.preview_hashes == ["h3", None, "h1"] and old.top_tags == ["x", "y", "z"] and new.top_tags == []
    assert ids(n.burst_items(lib.captures, old.start_ts, old.end_ts)) == [3, 2, 1]
    assert {r.id: r.key for r in n.burst_membership(lib.captures).collect()} == {i: (old if i < 4 else new).key for i in range(1, 6)}
    with pytest.raises(ValueError):
        n.burst_items(lib.captures, 2, 1)


@pytest.mark.parametrize("seed", range(3))
def test_sessions_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = sorted((rng.randint(0, 4000) * (1 if seed else 100), i) for i in range(300))
    df = spark.createDataFrame([(t, i) for t, i in rows], "ts long, id long").repartition(5)
    got = {r.id: r.session_start for r in n.sessionize(df, "ts", 20, "id").collect()}
    last, start, want = None, None, {}
    for t, i in rows:
        start = t if last is None or t - last > 20 else start
        want[i], last = start, t
    assert got == want


def test_exact_duplicates(spark):
    lib = library(spark, [{"id": i, "created_ts": i, "content_hash": h, "status": st} for i, h, st in [(1, "a", "available"), (2, "a", "available"), (3, "a", "missing"), (4, "b", "available"), (5, None, "available"), (6, None, "available")]])
    assert [(r.key, r["count"], r.ids) for r in n.exact_duplicates(lib.captures).collect()] == [("a", 2, [2, 1])]
    assert ids(n.all_but_newest(lib.captures)) == [1]


@pytest.mark.parametrize("distance", [0, 3, 8, 11])
def test_leaders_equal_the_loop(spark, distance):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(6)]
    nodes = []
    for i in range(90):
        b = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            b ^= 1 << rng.randrange(64)
        nodes.append((i, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(nodes, "id long, bits long")
    d = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    pairs = {(r.lo, r.hi, r.d) for r in n.hamming_pairs(df, distance).collect()}
    assert pairs == {(i, j, d(a, b)) for i, a in nodes for j, b in nodes if i < j and d(a, b) <= distance}
    reps, want = [], {}
    for i, b in nodes:
        hit = next((r for r, rb in reps if d(b, rb) <= distance), None)
        if hit is None:
            reps.append((i, b))
        want[i] = i if hit is None else hit
    assert {r.id: r.leader for r in n.leaders(df, distance).collect()} == want


def test_similar_groups(spark):
    lib = library(spark, [{"id": i, "created_ts": i, "phash": f"{0x0102030405060708 + i:016x}"} for i in range(3)] + [{"id": 9, "phash": "not-hex"}])
    assert [(r.key, r["count"], r.ids) for r in n.similar_groups(lib.captures, 8).collect()] == [(0, 3, [2, 1, 0])]
    assert n.similar_groups(lib.captures, 0).collect() == []


def spread(seed, count):
    """Hashes (id, bits) around a few centres, some of them equal."""
    rng = random.Random(seed)
    centres, nodes = [rng.getrandbits(64) for _ in range(5)], []
    for i in range(count):
        b = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            b ^= 1 << rng.randrange(64)
        nodes.append((i, b - (1 << 64) if b >> 63 else b))
    return nodes


def apart(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize(("distance", "plain"), [(0, 10**9), (8, 10**9), (8, 0)])
def test_pairs_by_blocks_and_by_tiles(spark, monkeypatch, distance, plain):
    """Both ways give each pair once: blocks without shuffling pairs, tiles without an asked value; also between two sets."""
    monkeypatch.setattr(n, "COST_PLAIN", plain)
    monkeypatch.setattr(n, "TILE", 32)
    assert (n._blocks(distance, 200) is None) == (plain == 0)
    nodes = spread(distance, 200)
    df = spark.createDataFrame(nodes, "id long, bits long")
    got = n.hamming_pairs(df, distance)
    assert sorted(map(tuple, got.collect())) == sorted((i, j, apart(a, b)) for i, a in nodes for j, b in nodes if i < j and apart(a, b) <= distance)
    assert "keys=[lo" not in got._jdf.queryExecution().executedPlan().toString()
    other = n.near_pairs(df.where("id < 150"), df.where("id >= 150"), distance)
    assert sorted(map(tuple, other.collect())) == sorted((i, j, apart(a, b)) for i, a in nodes[:150] for j, b in nodes[150:] if apart(a, b) <= distance)


def test_leaders_by_ranges(spark, monkeypatch):
    """A dense cluster's pairs are made for its first members only: later ranges meet leaders."""
    monkeypatch.setattr(n, "FIRST_RANGE", 20)
    nodes, compared = spread(4, 400), []
    settled = n._settled
    monkeypatch.setattr(n, "_settled", lambda rest, distance: compared.append(rest.count()) or settled(rest, distance))
    got = {r.id: r.leader for r in n.leaders(spark.createDataFrame(nodes, "id long, bits long"), 20).collect()}
    reps, want = [], {}
    for i, b in nodes:
        hit = next((r for r, rb in reps if apart(b, rb) <= 20), None)
        if hit is None:
            reps.append((i, b))
        want[i] = i if hit is None else hit
    assert got == want
    assert len(compared) > 1 and sum(compared) < 200
