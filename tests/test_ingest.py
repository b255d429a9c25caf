import os
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from archive import ids, library
from capturelake.operators import organize, search
from capturelake.sources import files, thumbnails
from capturelake.streaming import watch


def png(path, width, height, seed=0):
    """An RGB picture, written by hand."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.repeat(np.repeat(rng.integers(0, 256, (height // 10 + 1, width // 10 + 1, 3)), 10, 0), 10, 1)[:height, :width].reshape(height, -1).astype(np.uint8)], axis=1)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b""))


def test_scan(spark, tmp_path):
    d = tmp_path / "in"
    png(d / "one.png", 300, 200, 1)
    png(d / "zweiü.PNG", 400, 250, 2)
    png(d / "deep" / "three.png", 100, 100, 3)
    (d / "notes.txt").write_text("x")
    (d / "corrupted.png").write_bytes(b"no picture")
    lib, counts = files.scan(library(spark, []), [str(d)])
    assert tuple(counts.first()) == (4, 0, 3, 1)
    assert [(p.kind, os.path.basename(p.path)) for p in organize.list_problems(lib).collect()] == [("unreadable", "corrupted.png")]
    rows = {r.filename: r for r in lib.captures.collect()}
    assert (rows["one.png"].width, rows["one.png"].height, rows["one.png"].format) == (300, 200, "png") and len(rows["one.png"].phash) == 16
    lib = organize.add_tag(lib, rows["one.png"].id, "kept")
    lib2, counts = files.scan(lib, [str(d)])
    assert tuple(counts.first()) == (4, 3, 0, 1) and lib2.captures.count() == 3

    # a moved file keeps its identity; a changed one is read again in place
    (d / "one.png").rename(d / "moved.png")
    png(d / "deep" / "three.png", 120, 100, 4)
    lost = lib.with_(captures=files.mark_missing(lib.captures, files.list_files(spark, [str(d)]), [str(d)]))
    assert lost.captures.where("status = 'missing'").count() == 1
    lib3, _ = files.scan(lost, [str(d)])
    now = {r.filename: r for r in lib3.captures.collect()}
    assert now["moved.png"].id == rows["one.png"].id and now["moved.png"].status == "available"
    assert (now["three.png"].id, now["three.png"].width, now["three.png"].ocr_status) == (rows["three.png"].id, 120, "queued")
    assert organize.detail(lib3, rows["one.png"].id).first().tags == ["kept"]
    assert ids(search.search_ids(lib3, "moved", 0)) == [rows["one.png"].id]


def test_same_content_restores_in_order(spark):
    lib = library(spark, [{"id": i, "path": f"/old/{i}.png", "content_hash": "h", "status": "missing", "created_ts": i} for i in (4, 5, 6)])
    new = library(spark, [{"id": i, "path": f"/new/{n}.png", "content_hash": "h"} for i, n in ((1, "b"), (2, "a"))]).captures
    after = {r.id: r for r in files.upsert(lib, new).captures.collect()}
    assert [(after[i].path, after[i].status, after[i].created_ts) for i in (4, 5, 6)] == [("/new/a.png", "available", 4), ("/new/b.png", "available", 5), ("/old/6.png", "missing", 6)]


def test_thumbnails(spark):
    df = spark.createDataFrame([(1, "p", "abcd", 1000, 500), (2, "p", "efgh", 10, 4000), (3, "p", "ijkl", 50, 20), (4, "p", "mnop", 0, 7)], "id long, path string, content_hash string, width long, height long")
    assert [(r.thumbnail, r.t_width, r.t_height) for r in thumbnails.plan(df, "/c/").collect()] == [("/c/ab/abcd_256.png", 256, 128), ("/c/ef/efgh_256.png", 1, 256), ("/c/ij/ijkl_256.png", 256, 102), ("/c/mn/mnop_256.png", 256, 256)]


def test_events(spark):
    lib = library(spark, [{"id": 1, "path": "/w/a.png", "content_hash": "A"}, {"id": 2, "path": "/w/b.png", "content_hash": "B"}, {"id": 3, "path": "/w/j.png", "content_hash": "J"}], tags=[(1, "t")])
    journal = spark.createDataFrame([(1, "b", 3, "/w/j.png", "/w/k.png", None, None)], lib.journal.schema)
    lib = lib.with_(journal=journal)
    renames = watch.rename_events(spark.createDataFrame([("/w/a.png", "/w/0.png", 5)], "from_path string, to_path string, seq long"))
    events = renames.union(spark.createDataFrame([("/w/b.png", "changed", 1), ("/w/b.png", "removed", 2), ("/w/x.txt", "changed", 3), ("/w/j.png", "removed", 4)], "path string, kind string, seq long"))
    found = library(spark, [{"id": 9, "path": "/w/0.png", "content_hash": "A"}]).captures
    after = {r.id: (r.path, r.status) for r in watch.apply_events(lib, events, found).captures.collect()}
    assert after == {1: ("/w/0.png", "available"), 2: ("/w/b.png", "missing"), 3: ("/w/j.png", "available")}


def test_watching_a_directory(spark, tmp_path):
    png(tmp_path / "in" / "a.png", 30, 30)
    (tmp_path / "in" / "b.txt").write_text("x")
    seen = []
    watch.watch(spark, str(tmp_path / "in"), lambda df, _: seen.extend(r.path for r in df.collect()), str(tmp_path / "state"), once=True).awaitTermination()
    assert [os.path.basename(p) for p in seen] == ["a.png"]
    shots = library(spark, [{"id": 1, "path": f"{tmp_path}/in/gone.png"}, {"id": 2, "path": "/elsewhere/x.png"}]).captures
    assert ids(watch.deletions(shots, files.list_files(spark, [str(tmp_path / "in")]), [str(tmp_path / "in")])) == [1]


def test_stream_sessions_agree_with_a_batch(spark, tmp_path):
    from capturelake.operators.insights import detect_bursts

    rows = [(t, i) for i, t in enumerate([0, 100, 200, 5000, 5100, 9000, 90000, 90010, 400000])]
    spark.createDataFrame(rows, "t long, id long").select(F.timestamp_seconds("t").alias("ts"), "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, id long").parquet(str(tmp_path / "in"))
    got = watch.collect_stream(watch.stream_sessions(stream, "ts", 300), str(tmp_path))
    batch = detect_bursts(library(spark, [{"id": i, "created_ts": t} for t, i in rows]).captures, 300)
    assert sorted((r.start_ts, r.end_ts, r["count"]) for r in got.collect()) == sorted((r.start_ts, r.end_ts, r["count"]) for r in batch.collect()) == [(0, 200, 3), (5000, 5100, 2), (90000, 90010, 2)]


def test_progress_is_throttled():
    from types import SimpleNamespace as Ns

    from capturelake.streaming.progress import Progress

    told = []
    p = Progress(lambda event, data: told.append(event), throttle=60)
    p.onQueryStarted(Ns(id=1, name="w"))
    for i in range(3):
        p.onQueryProgress(Ns(progress=Ns(id=1, batchId=i, numInputRows=5)))
    p.onQueryTerminated(Ns(id=1, exception=None))
    assert told == ["started", "progress", "complete"]


def test_headers_and_long_files(spark, tmp_path):
    import hashlib

    png(tmp_path / "a+ü [1] %41.png", 30, 20)
    head = bytearray((tmp_path / "a+ü [1] %41.png").read_bytes())
    head[16:24] = struct.pack(">II", 100_000, 100_000)
    (tmp_path / "huge.png").write_bytes(bytes(head))
    (tmp_path / "long.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 7, 9) + b"x" * 3_000_000)
    listed = files.list_files(spark, [str(tmp_path)]).union(spark.createDataFrame([(f"{tmp_path}/gone.png", 0, 1)], files.LISTED))
    good, problems = files.read_images(spark, listed)
    assert [(os.path.basename(r.path), r.width, r.height) for r in good.collect()] == [("a+ü [1] %41.png", 30, 20)]
    assert {os.path.basename(r.path): r.kind for r in problems.collect()} == {"huge.png": "too_large", "long.gif": "unreadable", "gone.png": "hash_failed"}
    (row,) = (b.to_pylist() for b in files._hashed(iter([__import__("pyarrow").RecordBatch.from_pydict({"path": [f"{tmp_path}/long.gif"]})])))
    assert row[0]["content_hash"] == hashlib.sha256((tmp_path / "long.gif").read_bytes()).hexdigest() and (row[0]["h_width"], row[0]["h_height"]) == (7, 9)
    assert files.header_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20") == (32, 16)
    assert files.header_size(b"RIFF....WEBPVP8X" + b"\0" * 8 + b"\x1f\0\0\x0f\0\0") == (32, 16) and files.header_size(b"no") is None


def test_thumbnails_are_made_once(spark, tmp_path):
    png(tmp_path / "in" / "one.png", 1000, 500, 4)
    lib, _ = files.scan(library(spark, []), [str(tmp_path / "in")])
    cache = str(tmp_path / "cache")
    (made,) = thumbnails.generate(spark, lib.captures, cache).collect()
    assert (made.t_width, made.t_height, made.problem) == (256, 128, None) and thumbnails.cache_count(spark, cache) == 1
    assert files.header_size(open(made.thumbnail, "rb").read(64)) == (256, 128)
    before = os.stat(made.thumbnail).st_mtime_ns
    (again,) = thumbnails.generate(spark, lib.captures, cache).collect()
    assert again.thumbnail == made.thumbnail and again.t_width is None and os.stat(made.thumbnail).st_mtime_ns == before
    assert thumbnails.plan(lib.captures, cache).first().thumbnail == made.thumbnail
    (named,) = thumbnails.generate(spark, lib.captures, f"file://{cache}").collect()  # by its URI it is the same cache
    assert named.t_width is None and thumbnails.cache_count(spark, f"file://{cache}") == 1 and thumbnails.cache_count(spark, cache + "/none") == 0


def test_library_follows_a_directory(spark, tmp_path):
    from capturelake import schemas

    root = str(tmp_path / "lib")
    library(spark, []).save(schemas.version_path(root, 1))
    png(tmp_path / "in" / "a.png", 40, 30, 1)
    watch.follow(spark, root, str(tmp_path / "in"), str(tmp_path / "state"), once=True, wait=3).awaitTermination()
    png(tmp_path / "in" / "b.png", 40, 30, 2)
    (tmp_path / "in" / "c.png").write_bytes(b"broken")
    watch.follow(spark, root, str(tmp_path / "in"), str(tmp_path / "state"), once=True, wait=3).awaitTermination()
    lib = schemas.load(spark, schemas.latest(root))
    assert sorted((r.id, r.filename, r.ocr_status) for r in lib.captures.collect()) == [(1, "a.png", "queued"), (2, "b.png", "queued")]
    assert [os.path.basename(r.path) for r in lib.problems.collect()] == ["c.png"] and schemas.version_of(schemas.latest(root)) == 3


def test_files_in_motion_are_left_for_later(spark, tmp_path):
    import threading
    import time

    png(tmp_path / "still.png", 10, 10)
    moving = tmp_path / "moving.png"
    moving.write_bytes(b"x")
    stop = threading.Event()

    def grow():
        while not stop.is_set():
            with moving.open("ab") as f:
                f.write(b"x")
            time.sleep(0.02)

    t = threading.Thread(target=grow)
    t.start()
    try:
        batch = spark.createDataFrame([(str(moving),), (str(tmp_path / "still.png"),), (str(tmp_path / "gone.png"),)], "path string")
        got = watch.stable(spark, batch, timeout=1.0, poll=0.2).collect()
    finally:
        stop.set()
        t.join()
    assert [os.path.basename(r.path) for r in got] == ["still.png"]
