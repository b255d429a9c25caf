"""Watching directories, and sessions of an endless stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from capturelake.functions.text import is_image
from capturelake.operators import ocr
from capturelake.operators.rename import pending_paths
from capturelake.plans.lineage import cut
from capturelake.schemas import Library
from capturelake.sources import files, parts
from capturelake.streaming import sessions

#: Schema of the binary file source, which a stream must be told.
FILE = "path string, modificationTime timestamp, length long, content binary"
#: How long a file may take to come to rest, and the time between two looks at it.
STABLE_SECONDS, POLL_SECONDS = 6.0, 0.25


def last_events(events: DataFrame) -> DataFrame:
    """The last of each path's (path, kind, seq) events, image files only."""
    return events.where(is_image(F.col("path"))).groupBy("path").agg(F.max_by("kind", "seq").alias("kind"))


def rename_events(renames: DataFrame) -> DataFrame:
    """(from_path, to_path, seq) as two events: the old path is removed, then the new one is there."""
    parts = F.array(F.struct(F.col("from_path").alias("path"), F.lit("removed").alias("kind")), F.struct(F.col("to_path").alias("path"), F.lit("changed").alias("kind")))
    return renames.select(F.explode(parts).alias("e"), "seq").where("e.path is not null").select("e.path", "e.kind", "seq")


def apply_events(lib: Library, events: DataFrame, found: DataFrame) -> Library:
    """A batch of events. ``found``: what the files of changed paths hold now (see :func:`files.upsert`).

    Paths of a rename in progress are left alone. Removals come first, so that a renamed file takes up its
    own capture; a path that was reported as changed but isn't there any more is removed.
    """
    last = last_events(events).join(pending_paths(lib), "path", "left_anti")
    here = found.select(F.col("path").alias("_p")).distinct()
    gone = last.join(here, F.col("path") == F.col("_p"), "left").where("kind = 'removed' and _p is null or kind <> 'removed' and _p is null").select("path")
    ids = lib.captures.join(gone, "path", "left_semi").select("id")
    lib = lib.with_(captures=cut(files.set_status(lib.captures, ids, "missing"), "removed"))
    fresh = cut(found.join(last, "path", "left_semi"), "fresh")
    known = lib.captures.select(F.col("id").alias("_k"))
    lib = files.upsert(lib, fresh)
    new = lib.captures.join(known, F.col("id") == F.col("_k"), "left_anti").select("id")
    return lib.with_(captures=ocr.queue(lib.captures, new))


def stable(spark: SparkSession, listed: DataFrame, timeout: float = STABLE_SECONDS, poll: float = POLL_SECONDS) -> DataFrame:
    """(path, modified_ts, size) of a batch's files once two looks in a row agree on size and time.

    Files that are still being written after ``timeout``, or are gone, aren't there. A batch is bounded (see
    :func:`file_stream`), so its paths may pass through the driver.
    """
    paths = [r.path for r in listed.select("path").collect()]

    def look() -> dict[str, tuple[int, int]]:
        found = {}
        for path in paths:
            fs, name = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
            info = fs.get_file_info(name)
            if info.is_file:
                found[path] = int((info.mtime_ns or 0) // 1000), info.size
        return found

    began, last, done = time.monotonic(), look(), {}
    while time.monotonic() - began < timeout and len(done) < len(last):
        time.sleep(poll)
        now = look()
        done |= {p: v for p, v in now.items() if last.get(p) == v}
        last = now
    rows = [(p, t // 1_000_000, n) for p, (t, n) in sorted(done.items()) if last.get(p) == (t, n)]
    return spark.createDataFrame(rows, files.LISTED)


def _keep(library_path: str, number: int, listed: DataFrame, removed: DataFrame | None = None, index_root: str | None = None) -> None:
    """Merge a batch's files, and paths that are gone, into the last version of a saved library, and save the next one; its text index follows by a segment.

    A batch that is saved already, as the query was started again before it had noted that, changes nothing."""
    from capturelake import schemas
    from capturelake.operators import text_index
    from capturelake.operators.organize import record_problems

    if parts.there(library_path):
        return _keep_parts(library_path, number, listed, removed, index_root)
    own, latest = listed.sparkSession, schemas.latest(library_path)
    if schemas.batch_of(latest) < number:
        lib = schemas.load(own, latest)
        good, problems = files.read_images(own, files.changed(listed, lib.captures))
        lib = record_problems(apply_events(lib, _told(listed, good, removed), good), problems)
        latest = schemas.version_path(library_path, schemas.version_of(latest) + 1, number)
        lib.save(latest)
    if index_root:
        text_index.follow(text_index.load(own, index_root), schemas.load(own, latest))


def _told(listed: DataFrame, good: DataFrame, removed: DataFrame | None) -> DataFrame:
    """A batch's events: files that were read, as unchanged ones tell nothing, and paths that are gone."""
    event = lambda df, kind: df.select("path", F.lit(kind).alias("kind"), F.lit(0).alias("seq"))
    events = event(listed, "changed").join(good, "path", "left_semi")
    return events if removed is None else events.unionByName(event(removed, "removed"))


def _keep_parts(root: str, number: int, listed: DataFrame, removed: DataFrame | None, index_root: str | None) -> None:
    """:func:`_keep` for a library in parts: only parts of captures that the batch can change are loaded, merged and written."""
    from capturelake.operators import text_index
    from capturelake.operators.organize import record_problems

    own, saved = listed.sparkSession, parts.load(listed.sparkSession, root)
    if saved.batch < number:
        near = saved.table("captures").join(listed.select("path").distinct(), "path", "left_semi")
        good, problems = files.read_images(own, files.changed(listed, near))
        good, problems = cut(good, "good"), cut(problems, "problems")
        paths = good.select("path") if removed is None else good.select("path").union(removed.select("path"))
        mine, end = parts.touched_by(saved, paths, good), saved.last("problems")
        old = saved.library(captures=mine, problems=end)
        lib = record_problems(apply_events(old, _told(listed, good, removed), good), problems)
        given = {"captures": mine}
        stale = old.ocr_text.join(lib.ocr_text.select("screenshot_id"), "screenshot_id", "left_anti").select(F.col("screenshot_id").alias("id"))
        if gone := saved.holding(stale):
            given["ocr_text"], lib = gone, lib.with_(ocr_text=lib.ocr_text.where(saved.within(gone)(F.col("screenshot_id"))))
        if not problems.isEmpty():
            given["problems"] = end
        saved = saved.commit(lib, given, number)
    if index_root:
        text_index.follow(text_index.load(own, index_root), saved.library(captures=saved.touched), saved.within(saved.touched))


def follow(spark: SparkSession, library_path: str, directory: str, checkpoint: str, once: bool = False, wait: float = STABLE_SECONDS, index_root: str | None = None) -> StreamingQuery:
    """Keep a saved library up with a directory: each batch of new files is awaited until stable, read, merged, queued
    for reading, and saved as the next version. Deletions are told by a listing (:func:`deletions`).

    A library in parts (:mod:`capturelake.sources.parts`) has the parts rewritten that a batch touches; one in folders ``<library_path>/v<n>`` is written whole.

    ``index_root``: the folder of the library's text index, which then follows too."""

    def on_batch(batch: DataFrame, number: int) -> None:
        _keep(library_path, number, stable(batch.sparkSession, batch, wait), index_root=index_root)

    return watch(spark, directory, on_batch, checkpoint, once)


def follow_events(library_path: str, settled: DataFrame, checkpoint: str, once: bool = False, index_root: str | None = None) -> StreamingQuery:
    """Keep a saved library up with a stream of events whose files have come to rest (:func:`capturelake.streaming.settle.settled`): changed files are
    read and merged, those of removed paths become missing, and files that never came to rest are left for their next event."""

    def on_batch(batch: DataFrame, number: int) -> None:
        rows = cut(batch, "events")
        if rows.isEmpty():
            return
        listed = rows.where("kind not in ('removed', 'unsettled')").select("path", "modified_ts", "size")
        _keep(library_path, number, listed, rows.where("kind = 'removed'"), index_root)

    w = settled.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="400 milliseconds")).start()


def file_stream(spark: SparkSession, directory: str, max_files: int = 64) -> DataFrame:
    """New files of a directory as a stream."""
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(directory)


def watch(spark: SparkSession, directory: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a watch; ``on_batch`` gets (path, modified_ts, size) of new image files. Stop the query and start
    another to change directories."""
    s = file_stream(spark, directory).select(files.plain_path(F.col("path")).alias("path"), F.col("modificationTime").cast("long").alias("modified_ts"), F.col("length").alias("size"))
    w = s.where(is_image(F.col("path"))).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="400 milliseconds")).start()


def deletions(captures: DataFrame, listed: DataFrame, directories: list[str]) -> DataFrame:
    """Ids of live captures below directories that a fresh listing lacks; a file stream tells nothing of these."""
    now = files.mark_missing(captures, listed, directories)
    return now.where("status = 'missing'").join(captures.where("status <> 'missing'"), "id", "left_semi").select("id")


def stream_sessions(events: DataFrame, ts: str, gap_seconds: int, watermark: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """Sessions of two or more rows with steps of a gap at most, as they close behind the watermark. Times count in
    whole seconds, as in a batch. Without keys all rows are one sequence, cut by ranges of time (:mod:`capturelake.streaming.sessions`)."""
    if keys is None:
        return sessions.sessions(events, ts, gap_seconds, watermark)
    events = events.withColumn(ts, F.date_trunc("second", ts))
    w = F.session_window(ts, f"{gap_seconds} seconds")
    g = events.withWatermark(ts, watermark).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("count"), F.min(ts).alias("first"), F.max(ts).alias("last")).where("count > 1")
    return g.select(*keys, F.col("first").cast("timestamp").cast("long").alias("start_ts"), F.col("last").cast("timestamp").cast("long").alias("end_ts"), "count")


def collect_stream(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and read what it wrote."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
