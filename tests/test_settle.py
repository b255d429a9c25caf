import datetime as dt
import time

from capturelake.streaming import settle

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def event(path, kind, seq, seconds, size=None):
    return (path, kind, seq, T0 + dt.timedelta(seconds=seconds), size, size)


def run(spark, folder, batches, **how):
    """Each batch as one start of the query; what it tells, by batch."""
    session = spark.newSession()
    settle.with_rocksdb(session)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    told = []
    for events in batches:
        spark.createDataFrame(events, settle.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = settle.settled(session.readStream.schema(settle.EVENT).parquet(f"{folder}/in"), **how)
        rows = []
        q = stream.writeStream.foreachBatch(lambda df, _, rows=rows: rows.extend(df.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        told.append(sorted((r.path, r.kind, r.seq, r.size) for r in rows))
    return told


def test_a_file_that_grows_over_three_batches(spark, tmp_path):
    """It is told once, with its last size, when it has been quiet; a removed one too; one that never rests is told as such; other files aren't told."""
    clock = lambda s: event("/tick.txt", "changed", 0, s)
    batches = [
        [event("/a.png", "created", 1, 0, 10), event("/gone.png", "removed", 1, 0), event("/busy.png", "changed", 1, 0, 1)],
        [event("/a.png", "changed", 2, 1, 20), event("/busy.png", "changed", 2, 1, 2), event("/a.png", "changed", 1, 1, 15)],
        [event("/a.png", "changed", 3, 2, 30), event("/busy.png", "changed", 3, 2, 3), clock(3)],
        [event("/busy.png", "changed", 4, 3.5, 4), event("/b.png", "changed", 1, 4, 5), clock(4.6)],
        [event("/busy.png", "changed", 5, 5, 5), event("/a.png", "changed", 3, 5, 30), clock(20)],
        [clock(21)],
    ]
    told = run(spark, tmp_path, batches, rest=1500, most=5000, by_event=True)
    seen = [x for batch in told for x in batch]
    assert [x for x in seen if x[0] == "/a.png"][0] == ("/a.png", "changed", 3, 30)
    assert ("/gone.png", "removed", 1, None) in seen and ("/b.png", "changed", 1, 5) in seen
    assert [x[1] for x in seen if x[0] == "/busy.png"] == ["unsettled"]
    assert not told[0] and not told[1] and not [x for x in seen if x[0].endswith("txt")]


def test_by_the_machines_clock(spark, tmp_path):
    session = spark.newSession()
    settle.with_rocksdb(session)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    spark.createDataFrame([event("/a.png", "changed", 1, 0, 10)], settle.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = settle.settled(session.readStream.schema(settle.EVENT).parquet(f"{tmp_path}/in"), rest=300)
    q = stream.writeStream.format("memory").queryName("rested").start()
    try:
        until = time.time() + 60
        while time.time() < until and session.table("rested").count() == 0:
            time.sleep(0.5)
        assert [(r.path, r.size) for r in session.table("rested").collect()] == [("/a.png", 10)]
    finally:
        q.stop()


def test_library_and_index_follow_events(spark, tmp_path):
    """Settled events make versions of the library and of its index; a removed file becomes missing."""
    import os

    from archive import library
    from test_ingest import png

    from capturelake import schemas
    from capturelake.operators import text_index
    from capturelake.streaming import watch

    session = spark.newSession()
    settle.with_rocksdb(session)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    root, index = str(tmp_path / "lib"), str(tmp_path / "index")
    lib = library(session, [])
    lib.save(schemas.version_path(root, 1))
    text_index.build(lib, index)
    png(tmp_path / "in" / "zebra.png", 40, 30, 1)
    path = str(tmp_path / "in" / "zebra.png")
    fact = os.stat(path)
    there = (path, "created", 1, T0, fact.st_size, int(fact.st_mtime))
    gone = (path, "removed", 2, T0 + dt.timedelta(seconds=20), None, None)
    batches = [[there], [event("/tick.txt", "changed", 0, 10)], [event("/tick.txt", "changed", 0, 11)], [gone], [event("/tick.txt", "changed", 0, 40)], [event("/tick.txt", "changed", 0, 41)]]
    seen = []
    for rows in batches:
        session.createDataFrame(rows, settle.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = settle.settled(session.readStream.schema(settle.EVENT).parquet(f"{tmp_path}/events"), by_event=True)
        watch.follow_events(root, stream, f"{tmp_path}/state", once=True, index_root=index).awaitTermination()
        shots = schemas.load(session, schemas.latest(root)).captures.collect()
        seen.append([(r.filename, r.status) for r in shots])
    assert seen[0] == [] and seen[2] == [("zebra.png", "available")] and seen[-1] == [("zebra.png", "missing")]
    words = {r.token for r in text_index.load(session, index).vocabulary().collect()}
    assert words == {"zebra", "png"}
