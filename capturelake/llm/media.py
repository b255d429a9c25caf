"""Texts as PNG images in binary columns, and hashes of their low frequencies.

A payload (UTF-8 bytes, filled with spaces to a positive multiple of ``WIDTH``)
is an 8-bit grey image ``WIDTH`` samples wide: PNG signature, IHDR, zlib-packed
IDAT chunks of at most ``CHUNK`` bytes, IEND, each with its CRC. The reader
takes any non-interlaced 8-bit PNG without a palette: it tests the signature,
each chunk's CRC, the zlib checksum and the size, and undoes the five row filters
with numpy. The feature is the sign of the low-frequency cosine coefficients of
the image averaged to 32 by 32 samples, against their median: 64 bits.

Nulls and odd input: a null or empty text is one row of spaces. Equal texts
give equal rows; repeated rows stay. A text of any length is one image, held
whole by one task. A damaged file raises :class:`DamagedImage`; in
``read_images`` it gives null columns and the reason. Empty tables give no rows.
Own columns named ``media``, ``n_bytes`` or ``read`` stay; the new ones then have underscores before their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import add_from_text, free_name

#: Samples of a row, bytes of an IDAT chunk, zlib's level, side of the averaged image, side of the block of coefficients.
WIDTH, CHUNK, LEVEL, SIDE, LOW = 192, 1 << 20, 6, 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class DamagedImage(ValueError):
    pass


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b" " * (-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(samples: np.ndarray, filter_type: int | None = None) -> bytes:
    """A grey image from rows of 8-bit samples; filters 0 (none), 1 (sub) and 2 (up), or for each row
    the one with the least sum of signed bytes' magnitudes (the first on ties)."""
    height, width = samples.shape
    rows = np.empty((height, width + 1), dtype=np.uint8)
    rows[:, 0], rows[:, 1:] = filter_type or 0, samples
    if filter_type is None:
        made = np.stack([samples] * 3)
        made[1, :, 1:] -= samples[:, :-1]
        made[2, 1:] -= samples[:-1]
        rows[:, 0] = np.minimum(made, -made).sum(axis=2, dtype=np.int64).argmin(axis=0)
        rows[:, 1:] = made[rows[:, 0], np.arange(height)]
    elif filter_type == 1:
        rows[:, 2:] -= samples[:, :-1]
    elif filter_type == 2:
        rows[1:, 1:] -= samples[:-1]
    packed = zlib.compress(rows.tobytes(), LEVEL)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Rows with their filter bytes to samples; runs of rows with one filter go together where numpy can."""
    kinds, data = rows[:, 0], rows[:, 1:].copy()
    height, width = data.shape
    y = 0
    while y < height:
        kind, end = kinds[y], y + 1
        while end < height and kinds[end] == kind:
            end += 1
        block = data[y:end]
        above = data[y - 1] if y else np.zeros(width, dtype=np.uint8)
        if kind == 1:
            block[:] = np.cumsum(block.reshape(end - y, -1, bpp), axis=1, dtype=np.uint8).reshape(end - y, width)
        elif kind == 2:
            block[0] += above
            block[:] = np.cumsum(block, axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for row in block:
                left, corner = np.zeros(bpp, dtype=np.int32), np.zeros(bpp, dtype=np.int32)
                for x in range(0, width, bpp):
                    up = above[x : x + bpp].astype(np.int32)
                    if kind == 3:
                        guess = (left + up) >> 1
                    else:
                        p = left + up - corner
                        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                    left = (row[x : x + bpp] + guess) & 255
                    row[x : x + bpp] = left
                    corner = up
                above = row
        elif kind != 0:
            raise DamagedImage(f"row {y} has filter {kind}")
        y = end
    return data


def read_png(data: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit PNG; raises DamagedImage for anything that isn't whole."""
    if data[:8] != SIGNATURE:
        raise DamagedImage("no PNG signature")
    at, packed, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise DamagedImage("a chunk is cut off")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        crc = data[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise DamagedImage(f"the checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended:
        raise DamagedImage("IHDR or IEND is missing")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in (0, 2, 4, 6) or interlaced:
        raise DamagedImage("only 8-bit samples without palette or interlacing are read")
    bpp = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise DamagedImage(str(e)) from e
    if len(raw) != height * (width * bpp + 1):
        raise DamagedImage("the samples don't fill the image")
    return _unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(height, width * bpp + 1), bpp)


_k = np.arange(SIDE)
_COS = np.cos(np.pi * (2 * _k[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def low_frequencies(samples: np.ndarray) -> bytes:
    """64 bits: cosine coefficients up to LOW in both directions, above their median without the mean."""
    if len(samples) < SIDE:
        samples = samples[np.arange(SIDE) * len(samples) // SIDE]
    c = _COS @ _shrink(samples) @ _COS.T
    c = np.round(c, 6).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes()


def _shrink(samples: np.ndarray) -> np.ndarray:
    """Means over SIDE by SIDE parts of near equal size."""
    h, w = samples.shape
    rows, cols = np.arange(SIDE) * h // SIDE, np.arange(SIDE) * w // SIDE
    sums = np.add.reduceat(np.add.reduceat(samples, rows, axis=0, dtype=np.int64), cols, axis=1)
    return sums / np.outer(np.diff(np.append(rows, h)), np.diff(np.append(cols, w)))


def to_images(docs: DataFrame, text_col: str = "text", filter_type: int | None = None) -> DataFrame:
    """``docs`` with two more columns at its end: media (a PNG) and n_bytes of the text. Where ``docs`` has columns of
    these names, they stay and the new ones have underscores before theirs."""
    fields = [T.StructField(free_name(docs, "media"), T.BinaryType()), T.StructField(free_name(docs, "n_bytes"), T.LongType())]

    def make():
        def run(texts):
            made = [payload_of(t) for t in texts]
            return [[write_png(np.frombuffer(p, dtype=np.uint8).reshape(-1, WIDTH), filter_type) for p, _ in made], [n for _, n in made]]

        return run

    return add_from_text(docs, text_col, fields, make)


READ = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("low", T.BinaryType()), T.StructField("problem", T.StringType()),
])


def read_images(images: DataFrame, media_col: str = "media") -> DataFrame:
    """``images`` with a struct column ``read`` of what the stored bytes hold: the payload's
    length and digests, the file's, the hash ``low`` as binary, or what is wrong with the file."""
    name = free_name(images, "read")

    def make():
        def one(data):
            own = {"media_bytes": None if data is None else len(data), "media_sha256": None if data is None else hashlib.sha256(data).hexdigest()}
            try:
                if data is None:
                    raise DamagedImage("null")
                samples = read_png(data)
            except DamagedImage as e:
                return own | {"problem": str(e)}
            payload = samples.tobytes()
            return own | {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "low": low_frequencies(samples)}

        return lambda blobs: [[one(b) for b in blobs]]

    return add_from_text(images, media_col, [T.StructField(name, READ)], make)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its image written, read back, and measured."""
    images = to_images(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    read = read_images(images)
    return read.select("doc_id", "n_bytes", *(F.col(f"read.{c}").alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")), F.lower(F.hex("read.low")).alias("feature"))
