"""Sets of word n-grams as sorted 64-bit hashes, computed on UTF-8 bytes in batches."""

from __future__ import annotations

import hashlib

import numpy as np

from .bytegrams import SLICE, Rolled, mix

SPACES = b" \t\n\x0b\x0c\r"
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _lowered() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[list(SPACES)] = True
    return low, space


_LOW, _SPACE = _lowered()


def _parts(texts: list[bytes]):
    """(owner, bytes) of at most SLICE bytes, cut at white space; a longer word comes alone and whole."""
    for owner, text in enumerate(texts):
        at = 0
        while len(text) - at > SLICE:
            cut = max(text.rfind(bytes([c]), at, at + SLICE) for c in SPACES)
            if cut <= at:
                ends = [e for e in (text.find(bytes([c]), at + 1) for c in SPACES) if e >= 0]
                cut = min(ends, default=len(text))
            yield owner, text[at:cut]
            at = cut
        yield owner, text[at:]


def _long_word(word: bytes) -> np.ndarray:
    digest = hashlib.blake2b(_LOW[np.frombuffer(word, dtype=np.uint8)].tobytes(), digest_size=8).digest()
    return np.frombuffer(digest, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every word in order. Only ASCII letters are lower-cased."""
    owners, hashes = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]

    def flush(batch: list[tuple[int, bytes]]) -> None:
        data = _LOW[np.frombuffer(b" ".join([*(part for _, part in batch), b""]), dtype=np.uint8)]
        inside = ~_SPACE[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            bounds = np.cumsum([len(part) + 1 for _, part in batch])
            owners.append(np.array([owner for owner, _ in batch])[np.searchsorted(bounds, start, side="right")])
            hashes.append(Rolled(data).at(start, end - start))

    batch: list[tuple[int, bytes]] = []
    size = 0
    for owner, part in _parts(texts):
        if len(part) > SLICE and len(word := part.strip(SPACES)) > SLICE:
            flush(batch)
            batch, size = [], 0
            owners.append(np.array([owner]))
            hashes.append(_long_word(word))
            continue
        if size + len(part) > SLICE and batch:
            flush(batch)
            batch, size = [], 0
        batch.append((owner, part))
        size += len(part) + 1
    flush(batch)
    return np.concatenate(owners), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct n-grams, sorted by hash; fewer words are one n-gram, and no words none."""
    owner, hashes = word_hashes(texts)
    n = len(hashes)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(words, n)):
        total[: n - k] += hashes[k:] * _ODD[k]
    grams = mix(total)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= words:
            out.append(np.unique(grams[low : high - words + 1]))
        elif high > low:
            short = (hashes[low:high] * _ODD[: high - low]).sum(dtype=np.uint64, keepdims=True) + _ODD[words + high - low]
            out.append(mix(short))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
