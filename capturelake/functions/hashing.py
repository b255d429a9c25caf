"""Content digests and 64-bit perceptual hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Cells of the grey grid that a hash compares.
GRID_W, GRID_H = 9, 8


def content_hash(content: Column) -> Column:
    """SHA-256 in lower-case hex."""
    return F.sha2(content, 256)


def phash_to_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def phash_from_hex(hex_: Column) -> Column:
    """The hash as a signed bigint; null for anything but up to 16 hex digits."""
    ok = hex_.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(ok, F.conv(F.when(ok, hex_), 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def triangle_weights(n_in: int, n_out: int) -> np.ndarray:
    """A triangle filter's matrix from n_in to n_out samples, each row summing to 1."""
    scale = n_in / n_out
    reach = max(1.0, scale)
    centre = (np.arange(n_out) + 0.5) * scale - 0.5
    w = np.maximum(0.0, 1 - np.abs(np.arange(n_in)[None, :] - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def dhash(grey: np.ndarray) -> int:
    """64 bits of left > right, row by row, most significant first."""
    grid = np.rint(triangle_weights(grey.shape[0], GRID_H) @ grey @ triangle_weights(grey.shape[1], GRID_W).T)
    bits = np.packbits(grid[:, :-1] > grid[:, 1:]).tobytes()
    return int.from_bytes(bits, "big")


def luma(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Grey samples from interleaved bytes: blue, green, red (and alpha), or grey."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return a[:, :, 0] if channels == 1 else np.rint(a[:, :, 2] * 0.2126 + a[:, :, 1] * 0.7152 + a[:, :, 0] * 0.0722)


@F.pandas_udf(StringType())
def perceptual_hash(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    """16 hex digits for each decoded image, null where it has no pixels."""
    return pd.Series([
        f"{dhash(luma(d, h, w, c)):016x}" if d is not None and h > 0 and w > 0 else None
        for d, h, w, c in zip(data, height, width, channels, strict=True)
    ])
