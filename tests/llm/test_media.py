import hashlib
import struct
import zlib

import numpy as np
import pytest

from loomline.llm import media


def test_round_trip(spark):
    texts = ["", None, "a" * 64, "é" * 33, "line\n" * 40000, "\x00x"]
    docs = spark.createDataFrame([(i, t, b"old") for i, t in enumerate(texts)] + [(None, "a" * 64, b"old")], "doc_id long, text string, media binary")
    stored = media.to_media(docs)
    rows = media.media_features(stored).collect()
    for r in rows:
        data = ("a" * 64 if r.doc_id is None else texts[r.doc_id] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > 0 and r.hash.hex() == r.feature
    assert len(rows) == len(texts) + 1
    assert len({r.feature for r in rows if r.doc_id in (2, None)}) == 1
    assert media.media_features(media.to_media(docs.limit(0))).count() == 0


def test_damage_is_found():
    whole = media.encode_png(media.padded(b"some text " * 50))
    for at in (0, 20, 50, len(whole) - 1):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises((media.MediaError, zlib.error, struct.error)):
            media.decode_png(bytes(bad))
    with pytest.raises((media.MediaError, struct.error)):
        media.decode_png(whole[:-6])
    packed = zlib.compress(media.filtered(np.zeros((1, 64), dtype=np.uint8)).tobytes())
    head = media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0))
    stored = lambda body, end=b"": media.SIGNATURE + head + media._chunk(b"IDAT", body) + media._chunk(b"IEND", b"") + end
    assert not media.decode_png(stored(packed)).any()
    for bad in (stored(packed[:-4]), stored(packed + b"x"), stored(packed, media._chunk(b"tEXt", b"x"))):
        with pytest.raises(media.MediaError):
            media.decode_png(bad)


def filtered(image, kind):
    """Rows under a filter type, by its definition."""
    out = []
    for y, row in enumerate(image.astype(int)):
        up = image[y - 1].astype(int) if y else np.zeros(image.shape[1], dtype=int)
        line = [kind]
        for x, value in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((value - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append(line)
    return np.array(out, dtype=np.uint8)


def test_all_filter_types_are_undone():
    image = np.random.default_rng(1).integers(0, 256, (9, 64)).astype(np.uint8)
    for kind in range(5):
        assert (media.unfilter(filtered(image, kind)) == image).all()
    rng = np.random.default_rng(3)
    for height in (1, 2, 7, 70):
        image = rng.integers(0, 256, (height, 64)).astype(np.uint8)
        every = [filtered(image, kind) for kind in range(5)]
        for most in (3, 5):
            mixed = np.array([every[k][y] for y, k in enumerate(rng.integers(0, most, height))])
            assert (media.unfilter(mixed) == image).all()
    with pytest.raises(media.MediaError):
        media.unfilter(np.full((1, 65), 5, dtype=np.uint8))


def test_rows_are_written_with_the_filter_that_fits():
    flat, ramp = np.full((4, 64), 7, dtype=np.uint8), np.cumsum(np.ones((4, 64)), axis=1).astype(np.uint8)
    rows = media.filtered(np.concatenate([np.zeros((1, 64), dtype=np.uint8), ramp[:1], flat, ramp]))
    assert rows[:, 0].tolist() == [0, 1, 1, 2, 2, 2, 1, 2, 2, 2]
    assert (media.unfilter(rows)[2:6] == 7).all()


def cosines(image):
    """The hash by its definition: means of spans, then the sums of cosines, then the median."""
    spans = lambda n: [(k * n // 32, max((k + 1) * n // 32, k * n // 32 + 1)) for k in range(32)]
    small = [[image[a:b, c:d].astype(float).mean() for c, d in spans(image.shape[1])] for a, b in spans(image.shape[0])]
    scale = lambda k: (1 / 32 if k == 0 else 2 / 32) ** 0.5
    cos = lambda k, x: np.cos(np.pi * (2 * x + 1) * k / 64)
    corner = [round(scale(u) * scale(v) * sum(small[y][x] * cos(u, y) * cos(v, x) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    return "".join("01"[int(c > np.median(corner[1:]))] for c in corner)


def test_hash_against_its_definition():
    rng = np.random.default_rng(4)
    for height in (1, 5, 40, 131):
        image = rng.integers(32, 127, (height, 64)).astype(np.uint8)
        got, want = f"{int(media.cosine_hash(image), 16):064b}", cosines(image)
        assert sum(a != b for a, b in zip(got, want)) <= 1


def test_like_images_have_like_hashes():
    rng = np.random.default_rng(2)
    image = np.cumsum(rng.integers(-2, 3, (200, 64)), axis=0).astype(float) + 128
    near = image + rng.normal(0, 0.5, image.shape)
    bits = lambda im: int(media.cosine_hash(np.clip(im, 0, 255).astype(np.uint8)), 16)
    assert (bits(image) ^ bits(near)).bit_count() <= 8
    assert (bits(image) ^ bits(rng.integers(0, 256, (200, 64)))).bit_count() >= 12
