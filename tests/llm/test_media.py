import hashlib
import struct
import zlib

import numpy as np
import pytest

from capturelake.llm import media


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_round_trip(kind):
    a = np.random.default_rng(kind).integers(0, 256, (37, 192)).astype(np.uint8)
    assert (media.read_png(media.write_png(a, kind)) == a).all()


def slow_filter(rows, bpp, kinds):
    """Filtered rows by the format's definition, a byte at a time."""
    out = []
    for y, kind in enumerate(kinds):
        line = [kind]
        for x in range(rows.shape[1]):
            left = int(rows[y, x - bpp]) if x >= bpp else 0
            up = int(rows[y - 1, x]) if y else 0
            corner = int(rows[y - 1, x - bpp]) if y and x >= bpp else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line.append((int(rows[y, x]) - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        out.append(bytes(line))
    return b"".join(out)


@pytest.mark.parametrize(("colour", "bpp"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters_and_many_chunks(colour, bpp):
    rng = np.random.default_rng(colour)
    a = rng.integers(0, 256, (12, 6 * bpp)).astype(np.uint8)
    packed = zlib.compress(slow_filter(a, bpp, rng.integers(0, 5, 12).tolist()))
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 12, 8, colour, 0, 0, 0)) + media._chunk(b"tEXt", b"note")
    png += b"".join(media._chunk(b"IDAT", packed[i : i + 7]) for i in range(0, len(packed), 7)) + media._chunk(b"IEND", b"")
    assert (media.read_png(png) == a).all()


def test_damage_is_found():
    good = media.write_png(np.full((3, 192), 7, dtype=np.uint8))
    for bad in (b"", good[:20], good[:-12], good[:40] + bytes([good[40] ^ 1]) + good[41:], b"x" + good[1:]):
        with pytest.raises(media.DamagedImage):
            media.read_png(bad)


def test_query_columns(spark):
    texts = ["", None, "a", "é" * 96, "x" * 192, "y" * 100_000, "a"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in media.media_features(docs).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(-(-max(1, len(data)) // 192) * 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.write_png(np.frombuffer(payload, np.uint8).reshape(-1, 192))
        assert (r.media_bytes, r.media_sha256, len(r.feature)) == (len(stored), hashlib.sha256(stored).hexdigest(), 16)
    assert got[2].feature == got[6].feature
    assert media.media_features(docs.limit(0)).collect() == []


def test_damaged_rows_have_a_reason(spark):
    rows = spark.createDataFrame([(1, bytearray(b"no image")), (2, None)], "doc_id long, media binary")
    assert all(r.read.problem and r.read.payload_bytes is None for r in media.read_images(rows).collect())


def test_hash_is_of_low_frequencies():
    y, x = np.mgrid[0:64, 0:192]
    smooth = (127 + 60 * np.cos(x / 30) + 60 * np.cos(y / 9)).astype(np.uint8)
    noisy = np.clip(smooth + np.random.default_rng(0).integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    bits = lambda a: np.unpackbits(np.frombuffer(media.low_frequencies(a), np.uint8))
    assert (bits(smooth) != bits(noisy)).sum() < (bits(smooth) != bits(np.roll(smooth, 17, axis=0))).sum()


def test_query_writes_real_filters(spark):
    docs = spark.createDataFrame([(1, "the same words over and over " * 200), (2, "aabbccddeeff" * 9)], "doc_id long, text string")
    seen = set()
    for r in media.to_images(docs).collect():
        raw = zlib.decompress(r.media[8 + 25 + 8 : -12 - 4])  # one IDAT between IHDR and IEND
        kinds = raw[:: media.WIDTH + 1]
        seen |= set(kinds)
        assert media.read_png(r.media).tobytes() == media.payload_of(r.text)[0]
    assert {1, 2} <= seen


def test_columns_of_the_table_stay(spark):
    docs = spark.createDataFrame([(1, "abc", "own", 7)], "doc_id long, text string, media string, n_bytes int")
    got = media.to_images(docs)
    assert got.columns == ["doc_id", "text", "media", "n_bytes", "_media", "_n_bytes"]
    row = got.first()
    assert (row.media, row.n_bytes, row._n_bytes) == ("own", 7, 3) and media.read_png(bytes(row._media)).tobytes()[:3] == b"abc"
