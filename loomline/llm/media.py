"""Payloads as PNG images in a binary column, read back with checksum tests, and perceptual hashes of them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_column

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in an image row; a payload is padded to a multiple of it.
WIDTH = 64
#: Bytes of compressed data in one IDAT chunk.
CHUNK = 1 << 16
#: The side of the reduced image, and of the corner of low frequencies that the hash keeps.
REDUCED, LOW = 32, 8


class MediaError(ValueError):
    """A stored form that is not what its checksums or its header say."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """The data with zero bytes up to a positive multiple of the unit."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Image rows that begin with their filter type: of none, left and above, the one with the least sum of distances
    from zero, as the format's authors advise. The types that take averages are read, but not written: undoing them
    can't be done row by row."""
    options = np.zeros((3, *rows.shape), dtype=np.uint8)
    options[:] = rows
    options[1, :, 1:] -= rows[:, :-1]
    options[2, 1:] -= rows[:-1]
    best = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    return np.concatenate([best[:, None].astype(np.uint8), options[best, np.arange(len(rows))]], axis=1)


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit greyscale image with one sample a byte, and a filter chosen for each row."""
    rows = filtered(np.frombuffer(payload, dtype=np.uint8).reshape(-1, width))
    packer = zlib.compressobj(level)
    body = packer.compress(rows.tobytes()) + packer.flush()
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at = 8
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if len(media) < at + 12 + size or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise MediaError(f"chunk {kind!r} is cut off or fails its checksum")
        yield kind, data
        at += 12 + size


def _from_above(rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows with the running sums of those marked `above` added, each run of them on the row before it."""
    sums = np.cumsum(rows, axis=0, dtype=np.uint8)
    base = np.maximum.accumulate(np.where(above, -1, np.arange(len(rows))))
    start = np.concatenate([np.zeros((1, rows.shape[1]), dtype=np.uint8), sums])[base + 1]
    kept = np.where(base[:, None] >= 0, rows[np.maximum(base, 0)], 0).astype(np.uint8)
    return np.where(above[:, None], sums - start + kept, rows)


def _by_diagonals(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Samples of rows of any filter type: those with one sum of row and column depend on the two sums before alone,
    so each such diagonal is one array operation."""
    height, width = rows.shape
    out = np.zeros((height + 1, width + 1), dtype=np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + up - corner
        a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(kinds[y], [np.zeros_like(left), left, up, (left + up) // 2, paeth])
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of greyscale rows that each begin with their filter type, by array operations."""
    kinds, out = rows[:, 0], rows[:, 1:]
    if kinds.max(initial=0) > 4:
        raise MediaError(f"filter type {kinds.max()}")
    if kinds.max(initial=0) > 2:
        return _by_diagonals(out, kinds)
    left = kinds == 1
    out = np.where(left[:, None], np.cumsum(out, axis=1, dtype=np.uint8), out)
    return _from_above(out, kinds == 2)


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale image, with every chunk's checksum tested."""
    header, body, ended = None, zlib.decompressobj(), False
    raw = []
    for kind, data in _chunks(media):
        if ended:
            raise MediaError("the image goes on after its end")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            raw.append(body.decompress(data))
        ended |= kind == b"IEND"
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not a whole 8-bit greyscale image")
    flat = np.frombuffer(b"".join([*raw, body.flush()]), dtype=np.uint8)
    if not body.eof or body.unused_data:
        raise MediaError("the compressed data is cut off, or goes on after its end")
    if len(flat) != header[1] * (header[0] + 1):
        raise MediaError("the image has another number of samples than its header says")
    return unfilter(flat.reshape(header[1], header[0] + 1))


@lru_cache(1)
def _cosines() -> np.ndarray:
    """Rows 0 to LOW - 1 of the orthonormal cosine transform of REDUCED points."""
    k, x = np.arange(LOW)[:, None], np.arange(REDUCED)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * REDUCED)) * np.sqrt(2 / REDUCED)
    basis[0] /= np.sqrt(2)
    return basis


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: which of the lowest LOW x LOW frequencies of the reduced image lie above their median.

    The image is reduced to REDUCED x REDUCED by means of equal spans of rows and columns; a shorter side repeats.
    """
    height, width = image.shape
    small = image.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        low = np.arange(REDUCED) * size // REDUCED
        high = np.maximum((np.arange(REDUCED) + 1) * size // REDUCED, low + 1)
        sums = np.concatenate([np.zeros_like(np.take(small, [0], axis)), np.cumsum(small, axis)], axis)
        span = (high - low).reshape((-1, 1) if axis == 0 else (1, -1))
        small = (np.take(sums, high, axis) - np.take(sums, low, axis)) / span
    basis = _cosines()
    corner = np.round((basis @ small @ basis.T).ravel(), 6)
    return f"{int(''.join('01'[bit] for bit in (corner > np.median(corner[1:])).astype(int)), 2):016x}"


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text", level: int = 1) -> DataFrame:
    """key, n_bytes and media: each text's UTF-8 bytes, padded to rows of WIDTH, as a PNG. Null counts as empty.

    Rows are mapped one by one, so repeated rows, empty tables and extra columns need no care; a very long text needs
    a few times its own size in memory.
    """

    def encoded(texts: list) -> list[list]:
        data = [(t or "").encode("utf-8") for t in texts]
        return [[len(d) for d in data], [encode_png(padded(d), WIDTH, level) for d in data]]

    return map_column(docs, text, [key], "n_bytes long, media binary", lambda: encoded)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary"


def read_media(stored: bytes | None) -> tuple:
    """FEATURES of a stored form; nulls for null."""
    if stored is None:
        return (None,) * 7
    image = decode_png(stored)
    payload, feature = image.tobytes(), cosine_hash(image)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, bytes.fromhex(feature)


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back from `media`: payload size, digests, and the cosine hash as hex and as 8 bytes.

    Raises MediaError where a stored form fails a checksum. A null media value gives null features.
    """
    read = lambda values: list(zip(*map(read_media, values))) or [[]] * 7
    return map_column(media, "media", [key, "n_bytes"], FEATURES, lambda: read)
