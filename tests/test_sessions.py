import random

import pytest
from pyspark.sql import functions as F

from capturelake.streaming import sessions, watch


def runs(seconds, gap):
    out = []
    for t in sorted(seconds):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return sorted(r for r in out if r[2] > 1)


def streamed(spark, folder, files, gap):
    """Each file is a batch."""
    for part in files:
        spark.createDataFrame([(t,) for t in part], "t long").select(F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = watch.collect_stream(watch.stream_sessions(stream, "ts", gap), str(folder))
    return sorted((r.start_ts, r.end_ts, r["count"]) for r in got.collect())


@pytest.mark.parametrize("seed", range(2))
def test_sessions_across_ranges_equal_runs(spark, tmp_path, seed):
    """Steps of a gap exactly, one more and one less, repeated times, sessions over many ranges, order mixed within a batch."""
    rng, gap = random.Random(seed), 100
    times, t = [], 0
    while t < 6000:
        t += rng.choice([0, 1, 20, 99, 100, 100, 100, 101, 250] if seed == 0 else [40, 60, 100, 100, 100, 100, 100, 100, 101])
        times.append(t)
    files = []
    for i in range(0, len(times), 40):
        part = times[i : i + 40]
        rng.shuffle(part)
        files.append(part)
    assert streamed(spark, tmp_path, [*files, [500_000]], gap) == runs(times, gap)


def test_null_times_and_empty_streams(spark, tmp_path):
    assert streamed(spark, tmp_path, [[None, None], []], 60) == []
    with pytest.raises(ValueError):
        watch.stream_sessions(spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/in"), "ts", 0)


def test_keys_of_their_own(spark, tmp_path):
    rows = [("a", 0), ("a", 50), ("b", 60), ("b", 500), ("a", 100_000), ("b", 100_000)]
    spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_seconds("t").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    got = watch.collect_stream(watch.stream_sessions(stream, "ts", 100, keys=["k"]), str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("a", 0, 50, 2)]


def test_a_row_stands_in_its_range_and_near_ones(spark):
    df = spark.createDataFrame([(-1,), (0,), (100,), (101,), (299,), (300,), (399,), (400,)], "t long")
    got = df.select("t", F.explode(sessions._ranges(F.col("t"), 100, 400)).alias("p")).groupBy("t").agg(F.sort_array(F.collect_list(F.struct("p.range", "p.side"))).alias("p"))
    want = {-1: [(-1, 0), (0, -1)], 0: [(-1, 1), (0, 0)], 100: [(-1, 1), (0, 0)], 101: [(0, 0)], 299: [(0, 0)], 300: [(0, 0), (1, -1)], 399: [(0, 0), (1, -1)], 400: [(0, 1), (1, 0)]}
    assert {r.t: [tuple(x) for x in r.p] for r in got.collect()} == want
