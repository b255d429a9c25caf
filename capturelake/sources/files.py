"""From image files to captures: listing, what has changed, reading, and merging.

Only files whose size or time differ from what is known are read: their bytes are hashed as a
stream, of any length, and their header tells how many pixels there are before anything is decoded.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capturelake.functions.hashing import perceptual_hash
from capturelake.functions.text import IMAGE_EXTENSIONS, extension, filename, is_image
from capturelake.operators.predicates import available
from capturelake.plans.lineage import cut, numbered
from capturelake.schemas import CAPTURES, Library

MOST_PIXELS = 80_000_000
LISTED = "path string, modified_ts long, size long"
#: Bytes of a file that are read at once, and paths that go to one read of Spark's image source.
BUFFER, CHUNK = 1 << 20, 10_000


def place(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the name in it."""
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """A file whole or not at all, however often a task runs."""
    where, name = place(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(part, compression=None) as f:
        f.write(data)
    try:
        where.move(part, name)
    except OSError:  # some stores don't replace what an earlier attempt left
        where.delete_file(name)
        where.move(part, name)


def plain_path(path):
    """A local path without its scheme, however the source wrote it."""
    return F.regexp_replace(path, "^file:/+", "/")


def list_files(spark: SparkSession, directories: list[str]) -> DataFrame:
    """(path, modified_ts, size) of image files below directories; content isn't read."""
    glob = "*.{" + ",".join(v for e in IMAGE_EXTENSIONS for v in sorted({e, e.upper(), e.capitalize()})) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(directories)
    return df.select(plain_path(F.col("path")).alias("path"), F.col("modificationTime").cast("timestamp").cast("long").alias("modified_ts"), F.col("length").alias("size")).where(is_image(F.col("path")))


def changed(listed: DataFrame, captures: DataFrame) -> DataFrame:
    """Listed files that no available capture has with the same size and time."""
    same = captures.where(available()).select("path", F.col("size").alias("_size"), F.col("modified_ts").alias("_mtime"))
    return listed.join(same, (listed.path == same.path) & (listed.size == F.col("_size")) & listed.modified_ts.eqNullSafe(F.col("_mtime")), "left_anti")


def header_size(head: bytes) -> tuple[int, int] | None:
    """Width and height by the first bytes of a PNG, GIF, BMP, WebP or JPEG file; None where they don't tell."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:4] == b"GIF8" and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        return width, abs(height)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        if head[12:16] == b"VP8X":
            return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
        if head[12:16] == b"VP8L":
            bits = int.from_bytes(head[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        return tuple(x & 0x3FFF for x in struct.unpack("<HH", head[26:30]))
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head) and head[at] == 0xFF:
            kind, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", head[at + 5 : at + 9])
                return width, height
            at += 1 if kind == 0xFF else 2 + size
    return None


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each path's file, null if it can't be read, and the size in its header."""
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            try:
                fs, name = place(path)
                sum_, first = hashlib.sha256(), None
                with fs.open_input_stream(name, compression=None) as f:
                    while part := f.read(BUFFER):
                        first = part if first is None else first
                        sum_.update(part)
                rows.append((path, sum_.hexdigest(), *(header_size(first or b"") or (None, None))))
            except OSError:
                rows.append((path, None, None, None))
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "content_hash", "h_width", "h_height"])


def decoded(spark: SparkSession, paths: DataFrame, use: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """What ``use`` makes of decoded pictures (path, width, height, nChannels, data) of a table of paths, written.

    Spark's image source takes a list of paths, so CHUNK of them at a time pass through the driver; each chunk's result is written.
    """
    origin = F.url_decode(F.replace(F.col("origin"), F.lit("+"), F.lit("%2B")))  # a URI, in which a plus is a plus
    out, todo = spark.createDataFrame([], schema), paths.select("path").toLocalIterator()
    while chunk := [re.sub(r"([\\{}\[\]*?])", r"\\\1", r.path) for r in itertools.islice(todo, CHUNK)]:
        img = spark.read.format("image").option("dropInvalid", False).load(chunk).select("image.*")
        out = out.union(cut(use(img.select(plain_path(origin).alias("path"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "nChannels", "data")), "pictures"))
    return out


def read_images(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, problems) of files: good have size, hashes and dimensions; problems path, kind, message.

    Pictures of too many pixels are known by their header, and are problems before they are decoded.
    """
    hashed = cut(files.select("path").repartition("path").mapInArrow(_hashed, "path string, content_hash string, h_width long, h_height long"), "hashed")
    large = F.coalesce(F.col("h_width") * F.col("h_height") > MOST_PIXELS, F.lit(False))
    ok = (F.col("height") > 0) & (F.col("width") * F.col("height") <= MOST_PIXELS)
    seen = lambda img: img.select("path", "width", "height", F.when(ok, perceptual_hash(F.when(ok, F.col("data")), "height", "width", "nChannels")).alias("phash"))
    pictures = decoded(spark, hashed.where(F.col("content_hash").isNotNull() & ~large), seen, "path string, width long, height long, phash string")
    known = cut(files.join(hashed, "path").join(pictures, "path", "left"), "images")
    bad = F.when(F.col("content_hash").isNull(), "hash_failed").when(large | (F.col("width") * F.col("height") > MOST_PIXELS), "too_large").when(F.col("width").isNull() | (F.col("width") <= 0), "unreadable")
    marked = known.withColumn("kind", bad)
    problems = marked.where("kind is not null").select("path", "kind", F.concat(F.lit("the file can't be used: "), "kind").alias("message"))
    ext = F.lower(F.substring(extension(filename(F.col("path"))), 2, 10))
    fmt = F.when(ext == "jpeg", "jpg").when(ext == "tif", "tiff").otherwise(ext)
    good = marked.where("kind is null").select("path", filename(F.col("path")).alias("filename"), "size", F.lit(None).cast("long").alias("created_ts"), "modified_ts", "width", "height", fmt.alias("format"), "content_hash", "phash")
    return good, problems


def restore_moved(captures: DataFrame, new: DataFrame) -> DataFrame:
    """(id, path): missing captures that new files with their content take up, in order of path and id."""
    lost = captures.where((F.col("status") == "missing") & F.col("content_hash").isNotNull())
    known = captures.select(F.col("path").alias("_p"))
    fresh = new.join(known, new.path == F.col("_p"), "left_anti")
    left = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("content_hash").orderBy("path"))).select("content_hash", "_n", "path")
    right = lost.withColumn("_n", F.row_number().over(Window.partitionBy("content_hash").orderBy("id"))).select("content_hash", "_n", "id")
    return left.join(right, ["content_hash", "_n"]).select("id", "path")


def upsert(lib: Library, new: DataFrame) -> Library:
    """Captures with ``new`` files merged in.

    A file with the content of a missing capture takes it up: path, name, size and time change, the
    rest stays. A known path gets the file's data and is queued for reading, its text goes;
    app, tags and marks stay. Other files get ids above all known, in order of path.
    """
    new = cut(new.select("path", "filename", "size", "created_ts", "modified_ts", "width", "height", "format", "content_hash", "phash"), "new")
    moved = cut(restore_moved(lib.captures, new), "moved")
    data = ("filename", "size", "created_ts", "modified_ts", "width", "height", "format", "content_hash", "phash")
    n = new.select(F.col("path").alias("n_path"), *(F.col(c).alias(f"n_{c}") for c in data))
    taken = moved.select(F.col("id").alias("m_id"), F.col("path").alias("m_path"))
    old = lib.captures.join(taken, F.col("id") == F.col("m_id"), "left").withColumn("_key", F.coalesce("m_path", "path"))
    both = old.join(n, F.col("_key") == F.col("n_path"), "left")
    hit, again = F.col("n_path").isNotNull(), F.col("m_id").isNotNull()
    columns = {c: F.when(hit & ~(again & F.lit(c == "created_ts")), F.col(f"n_{c}")).otherwise(F.col(c)) for c in data}
    columns |= {
        "status": F.when(hit, "available").otherwise(F.col("status")),
        "ocr_status": F.when(hit & ~again, "queued").otherwise(F.col("ocr_status")),
        "ocr_attempts": F.when(hit & ~again, 0).otherwise(F.col("ocr_attempts")).cast("long"),
        "path": F.col("_key"),
        "last_verified_at": F.when(hit, F.current_timestamp()).otherwise(F.col("last_verified_at")),
    }
    merged = cut(both.withColumns(columns).select(*lib.captures.columns, (hit & ~again).alias("_fresh")), "merged")
    top = lib.captures.agg(F.max("id")).first()[0] or 0
    added = new.join(merged.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_anti")
    added = numbered(added, "id", [F.asc("path")], top + 1)
    fixed = {"status": F.lit("available"), "ocr_status": F.lit("none"), "ocr_attempts": F.lit(0).cast("long"), "starred": F.lit(False), "read_later": F.lit(False), "note": F.lit(""), "indexed_at": F.current_timestamp(), "last_verified_at": F.current_timestamp()}
    row = [fixed[c.name].alias(c.name) if c.name in fixed else F.col(c.name).cast(c.dataType) if c.name in added.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in CAPTURES]
    stale = merged.where("_fresh").select(F.col("id").alias("_id"))
    text = lib.ocr_text.join(stale, F.col("screenshot_id") == F.col("_id"), "left_anti")
    return lib.with_(captures=merged.drop("_fresh").unionByName(added.select(*row)), ocr_text=text)


def mark_missing(captures: DataFrame, listed: DataFrame, directories: list[str]) -> DataFrame:
    """Captures below directories whose file isn't listed any more become missing."""
    below = F.lit(False)
    for d in directories:
        below = below | F.col("path").startswith(d.rstrip("/") + "/")
    here = listed.select(F.col("path").alias("_p")).distinct()
    df = captures.join(here, F.col("path") == F.col("_p"), "left")
    return df.withColumn("status", F.when(below & F.col("_p").isNull(), "missing").otherwise(F.col("status"))).select(*captures.columns)


def set_status(captures: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Missing, or available for what was missing."""
    df = captures.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & (F.lit(status == "missing") | (F.col("status") == "missing"))
    return df.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).select(*captures.columns)


def scan(lib: Library, directories: list[str]) -> tuple[Library, DataFrame]:
    """One scan of directories; also one row of counts: found, skipped, indexed, failed."""
    from capturelake.operators.organize import record_problems

    spark = lib.captures.sparkSession
    listed = cut(list_files(spark, directories), "listed")
    work = cut(changed(listed, lib.captures), "work")
    good, problems = read_images(spark, work)
    good, problems = cut(good, "good"), cut(problems, "problems")
    lib = record_problems(upsert(lib, good), problems)
    counts = listed.agg(F.count("*").alias("found")).crossJoin(work.agg(F.count("*").alias("work"))).crossJoin(good.agg(F.count("*").alias("indexed"))).crossJoin(problems.agg(F.count("*").alias("failed")))
    return lib, counts.select("found", (F.col("found") - F.col("work")).alias("skipped"), "indexed", "failed")
