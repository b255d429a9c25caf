"""Where thumbnails lie, how large they are, and making them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions.hashing import triangle_weights
from capturelake.plans.lineage import cut
from capturelake.sources.files import decoded, place, put

SIZES = (256, 512, 1024)
MADE = "content_hash string, thumbnail string, t_width long, t_height long, problem string"


def cache_path(root: str, hash_: Column, size: int) -> Column:
    if size not in SIZES:
        raise ValueError(f"unknown size {size}; there are {SIZES}")
    return F.concat(F.lit(root.rstrip("/") + "/"), F.substring(hash_, 1, 2), F.lit("/"), hash_, F.lit(f"_{size}.png"))


def dimensions(width: Column, height: Column, size: int) -> tuple[Column, Column]:
    """The longest side becomes ``size``, the sides' ratio is kept, at least 1; a picture without sides has a square."""
    scale = F.lit(float(size)) / F.greatest(width, height)
    none = (width == 0) | (height == 0)
    return tuple(F.when(none, size).otherwise(F.greatest(F.lit(1), F.round(x * scale))).cast("long") for x in (width, height))


def plan(captures: DataFrame, root: str, size: int = 256) -> DataFrame:
    """(id, path, thumbnail, t_width, t_height) of captures with content."""
    w, h = dimensions(F.col("width"), F.col("height"), size)
    return captures.where("content_hash is not null and width is not null and height is not null").select("id", "path", cache_path(root, F.col("content_hash"), size).alias("thumbnail"), w.alias("t_width"), h.alias("t_height"))


def png(samples: np.ndarray) -> bytes:
    """An 8-bit picture (height, width, 1, 3 or 4 channels) as a PNG file."""
    height, width, channels = samples.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))
    rows = np.concatenate([np.zeros((height, 1), dtype=np.uint8), samples.reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def shrunk(data: bytes, height: int, width: int, channels: int, size: int) -> np.ndarray:
    """A decoded picture (blue, green, red and alpha, or grey) within a square of ``size``, as red, green, blue."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    a = a if channels == 1 else a[:, :, [2, 1, 0, *range(3, channels)]]
    scale = size / max(width, height)
    h, w = (max(1, int(x * scale + 0.5)) for x in (height, width))
    rows, cols = triangle_weights(height, h), triangle_weights(width, w)
    return np.stack([np.clip(np.rint(rows @ a[:, :, c] @ cols.T), 0, 255).astype(np.uint8) for c in range(channels)], axis=2)


def _looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which thumbnails are there."""
    for b in batches:
        paths = b.column(b.schema.get_field_index("thumbnail")).to_pylist()
        there = pa.array([(info := place(p))[0].get_file_info(info[1]).is_file for p in paths], pa.bool_())
        yield pa.RecordBatch.from_arrays([*b.columns, there], names=[*b.schema.names, "there"])


def generate(spark: SparkSession, captures: DataFrame, root: str, size: int = 256) -> DataFrame:
    """Make the thumbnails of available captures that have none below ``root``, a folder or URI that all machines see. One row for
    each content: content_hash, thumbnail, t_width, t_height (null for one that was there), problem."""
    one = captures.where("status = 'available' and content_hash is not null").groupBy("content_hash").agg(F.min("path").alias("path"))
    wanted = one.select("path", "content_hash", cache_path(root, F.col("content_hash"), size).alias("thumbnail"))
    wanted = cut(wanted.mapInArrow(_looked, "path string, content_hash string, thumbnail string, there boolean"), "thumbnails")
    there = wanted.where("there").select("content_hash", "thumbnail", F.lit(None).cast("long").alias("t_width"), F.lit(None).cast("long").alias("t_height"), F.lit(None).cast("string").alias("problem"))
    todo = wanted.where("not there").select("path", "content_hash", "thumbnail")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if not r["data"] or r["height"] <= 0:
                    made = (None, None, "the picture can't be decoded")
                else:
                    small = shrunk(r["data"], r["height"], r["width"], r["nChannels"], size)
                    put(r["thumbnail"], png(small))
                    made = (small.shape[1], small.shape[0], None)
                names = ("content_hash", "thumbnail", "t_width", "t_height", "problem")
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((r["content_hash"], r["thumbnail"], *made), kinds, strict=True)], names=list(names))

    pictures = decoded(spark, todo.select("path"), lambda img: todo.join(img, "path").select("content_hash", "thumbnail", "width", "height", "nChannels", "data").mapInArrow(make, MADE), MADE)
    return there.unionByName(pictures)


def cache_count(spark: SparkSession, root: str) -> int:
    """How many files the cache has."""
    where, name = place(root)
    if not where.get_file_info(name).type.value:
        return 0
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").count()
