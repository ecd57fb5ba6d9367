"""Pixels of pictures: hashes, thumbnails and the search for a logo, over one row for each picture.

PNG of eight bits a sample without interlacing and uncompressed BMP of 24 or 32 bits are decoded, here with zlib and numpy;
other pictures have a null hash and no thumbnail.  Pictures are made smaller by means of areas and grey by the weights of
Rec. 709; transparency is left out.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.operators.images import average_hash, logo_detections

SIDE, THUMBNAIL = 8, 256
_GREY = np.array([0.2126, 0.7152, 0.0722])
#: Samples of a pixel by colour type of PNG.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: np.ndarray, n: int) -> np.ndarray:
    """Rows (kind of filter, then samples, ``n`` of a pixel) as samples."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.uint8)
    for y, row in enumerate(raw):
        kind, x = row[0], row[1:]
        if kind == 1:
            x = np.cumsum(x.reshape(-1, n), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            x = x + above
        elif kind in (3, 4):
            up, done = above.tolist(), [0] * n
            for i, v in enumerate(x.tolist()):
                a, b, c = done[i], up[i], up[i - n] if i >= n else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                done.append(v + guess & 255)
            x = np.array(done[n:], np.uint8)
        out[y] = above = x
    return out


def _png(b: bytes) -> np.ndarray | None:
    at, data, palette = 8, [], None
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", b[16:29])
    if depth != 8 or interlaced or colour not in _SAMPLES or not w or not h:
        return None
    while at + 8 <= len(b):
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        if kind == b"PLTE":
            palette = np.frombuffer(b[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(b[at + 8 : at + 8 + size])
        at += size + 12
    n = _SAMPLES[colour]
    need = h * (w * n + 1)
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(data), need), np.uint8)
    if len(raw) < need or (colour == 3 and palette is None):
        return None
    x = _unfiltered(raw.reshape(h, -1), n).reshape(h, w, n)
    if colour == 3:
        return palette[np.minimum(x[:, :, 0], len(palette) - 1)]
    return x[:, :, :3] if n > 2 else np.repeat(x[:, :, :1], 3, 2)


def _bmp(b: bytes) -> np.ndarray | None:
    begin, w, h, bits, packed = struct.unpack("<I", b[10:14]) + struct.unpack("<ii", b[18:26]) + struct.unpack("<HI", b[28:34])
    if bits not in (24, 32) or packed or w <= 0 or not h:
        return None
    line = (w * bits // 8 + 3) // 4 * 4
    if len(b) < begin + line * abs(h):
        return None
    x = np.frombuffer(b, np.uint8, line * abs(h), begin).reshape(abs(h), line)[:, : w * bits // 8].reshape(abs(h), w, -1)
    return x[:: -1 if h > 0 else 1, :, 2::-1]


def decoded(b: bytes | None) -> np.ndarray | None:
    """Red, green and blue by row and column, or None."""
    try:
        return None if not b else _png(b) if b[:8] == b"\x89PNG\r\n\x1a\n" else _bmp(b) if b[:2] == b"BM" else None
    except (struct.error, zlib.error, ValueError):
        return None


def _shares(n: int, m: int) -> np.ndarray:
    """What each of ``n`` cells gives to each of ``m`` that cover the same length."""
    edge = np.arange(m + 1) * (n / m)
    return np.clip(np.minimum(edge[1:, None], np.arange(n) + 1) - np.maximum(edge[:-1, None], np.arange(n)), 0, None) * (m / n)


def resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    return np.einsum("ij,jkc,lk->ilc", _shares(x.shape[0], h), x.astype(float), _shares(x.shape[1], w), optimize=True)


def grey_cells(b: bytes | None) -> list[float] | None:
    """64 grey values of a picture, made eight by eight."""
    x = decoded(b)
    return None if x is None else np.rint(resized(x, SIDE, SIDE) @ _GREY).ravel().tolist()


def thumbnail(b: bytes | None, most: int = THUMBNAIL) -> str | None:
    """PNG in base 64 of a picture, made smaller if it is larger than ``most`` in either direction."""
    x = decoded(b)
    if x is None:
        return None
    by = min(1.0, most / max(x.shape[:2]))
    h, w = (max(1, round(n * by)) for n in x.shape[:2])
    x = np.rint(resized(x, h, w)).astype(np.uint8) if by < 1 else x
    rows = np.concatenate([np.zeros((h, 1), np.uint8), x.reshape(h, -1)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return base64.b64encode(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")).decode()


def _each(images: DataFrame, data: str, over, kind: str, name: str) -> DataFrame:
    place = images.columns.index(data)
    of = pa.list_(pa.float64()) if kind == "array<double>" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [over(b.as_py()) for b in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, of)], [*batch.schema.names, name])

    return images.mapInArrow(run, images.select("*", F.lit(None).cast(kind).alias(name)).schema)


def hashed(images: DataFrame, data: str = "data") -> DataFrame:
    """``images`` with ``hash``, null for what can't be decoded."""
    return _each(images.drop("hash"), data, grey_cells, "array<double>", "__cells").withColumn("hash", average_hash(F.col("__cells"))).drop("__cells")


def with_thumbnails(images: DataFrame, data: str = "data") -> DataFrame:
    return _each(images.drop("thumbnail"), data, thumbnail, "string", "thumbnail")


def hash_of(b: bytes) -> str | None:
    """The hash of one picture, such as the logo to look for."""
    cells = grey_cells(b)
    return None if cells is None else f"{int(''.join('1' if x > sum(cells) / len(cells) else '0' for x in cells), 2):016x}"


def logo_scan(images: DataFrame, logo: bytes, threshold: float = 85, text: str = "[LOGO]") -> DataFrame:
    """Pictures (``doc_id``, ``image_id``, ``data``) as like the logo as ``threshold`` asks, as detections."""
    target = hash_of(logo)
    if target is None:
        raise ValueError("the logo is no picture that can be decoded")
    return logo_detections(hashed(images), target, threshold, text)
