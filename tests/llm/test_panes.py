import datetime as dt
import math
import random
import zlib
from pathlib import Path

import pytest

from capturelake.llm import panes
from capturelake.llm.panes import DAY, HOUR, RevisedPanes

COLUMNS = ("batch", "hour", "click_id", "n_rows", "cents", "record", "kind")


def brute(batches, width=HOUR, due=12 * HOUR, close=2 * DAY):
    """Records of lists of (id, event, kind, cents), by the definitions."""
    mark, open_, emitted, out = None, {}, set(), []
    for b, rows in enumerate(batches):
        passed = lambda h, after: mark is not None and mark >= (h + 1) * width + after  # noqa: E731, B023
        old = {}
        for i, event, kind, cents in rows:
            h = event // width
            if passed(h, close):
                out.append((b, h, i, 1, cents, "late", kind))
                continue
            old.setdefault((kind, h), open_.get((kind, h)))
            n, s = open_.get((kind, h), (0, 0))
            open_[kind, h] = (n + 1, s + cents)
        for p in list(open_):
            if p in emitted and p in old:
                out += [(b, p[1], -1, *old[p], "retract", p[0]), (b, p[1], -1, *open_[p], "replace", p[0])]
            elif p not in emitted and passed(p[1], due):
                emitted.add(p)
                out.append((b, p[1], -1, *open_[p], "emit", p[0]))
        for p in [p for p in open_ if passed(p[1], close)]:
            del open_[p]
            emitted.discard(p)
        mark = max([e for _, e, _, _ in rows] + ([] if mark is None else [mark]), default=None)
    out += [(len(batches) - 1, h, -1, *t, "final", k) for (k, h), t in open_.items() if (k, h) not in emitted]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_revisions(spark):
    """Random rows, before and after 1970, an empty first and a later empty batch, a jump that makes panes due and closed at once."""
    rng, batches, n = random.Random(3), [], 0
    for b, (low, high) in enumerate([(0, 0), (-30, 20), (-30, 40), (0, 0), (0, 90), (200, 260), (30, 262)]):
        rows = [(n := n + 1, rng.randrange(low * HOUR, high * HOUR) if k else (high - 1) * HOUR, rng.choice("ab"), rng.randrange(-5, 50)) for k in range(60)] if low != high else []
        batches.append(rows)
    run = RevisedPanes(spark)
    for rows in batches:
        run.feed(spark.createDataFrame(rows, "id long, event long, kind string, cents long"))
    got = rows_of(run.finish())
    assert got == brute(batches)
    assert {r[5] for r in got} == {"late", "emit", "retract", "replace", "final"}
    # the state forgets closed panes
    last = spark.read.parquet(f"{run.root}/snapshots/batch=6")
    assert last.where(F_closed(run)).count() == 0 and last.count() > 0


def F_closed(run):
    from pyspark.sql import functions as F

    return run._passed(F.col("hour"), run.marks[-1], run.close_after)


def test_clicks(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h, 30)
    rows = [(i, None if i % 11 == 0 else day(1 + i % 9, i % 24), day(1 + i % 9, 23) if i % 13 else None, None if i % 7 == 0 else "k", [None, float("nan"), float("inf"), 1.005, -2.5][i % 5], "x", i) for i in range(60)]
    rows += rows[:20] + [(None, day(3), day(3), "k", 1.0, "x", 0)] * 2
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, batch string, event long")
    got, batches, seen = rows_of(panes.click_panes(clicks)), [[] for _ in range(10)], set()
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    for i, ts, at, kind, value, _, _ in rows:
        if ts is None or i in seen:
            continue
        seen.add(i)
        d = us(at or ts) // DAY
        later = max(0, zlib.crc32(b"" if i is None else str(i).encode()) % 30 - 23)
        cents = 0 if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
        batches[min(9, d % 10 + later)].append((i, us(ts) - (d - d % 10) * DAY, kind or "none", cents))
    assert got == brute(batches)


def test_state_holds_no_native_memory(spark):
    """A store's files are those of maps on the heap: native instances, opened anew for each batch and partition, kept memory after they were closed."""
    run = RevisedPanes(spark)
    run.feed(spark.createDataFrame([(1, 0, "k", 1)], "id long, event long, kind string, cents long"))
    names = {p.name for p in Path(run.root.removeprefix("file://"), "checkpoint/state/0").rglob("1.*")}
    assert "1.delta" in names and not names & {"1.zip", "1.changelog"}, names


def test_empty(spark):
    clicks = spark.createDataFrame([], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double")
    assert panes.click_panes(clicks, batches=2).count() == 0
    assert RevisedPanes(spark).finish().columns == list(COLUMNS)


def test_sql_is_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow.parquet as pq

    from capturelake.llm import oracles

    path, batches, seen = "/root/testdata/sf0.001/clicks.parquet", [[] for _ in range(10)], set()
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    for r in pq.read_table(path).to_pylist():
        if r["ts"] is None or r["click_id"] in seen:
            continue
        seen.add(r["click_id"])
        d = us(r["arrived_at"]) // DAY
        cents = 0 if r["value"] is None else math.floor(100 * r["value"] + 0.5)
        batches[min(9, d % 10 + max(0, zlib.crc32(str(r["click_id"]).encode()) % 30 - 23))].append((r["click_id"], us(r["ts"]) - (d - d % 10) * DAY, r["kind"] or "none", cents))
    duckdb.sql(f"create or replace view clicks as select * from read_parquet('{path}')")
    rel = duckdb.sql(oracles.PANES)
    assert sorted(tuple(r[rel.columns.index(c)] for c in COLUMNS) for r in rel.fetchall()) == brute(batches)
