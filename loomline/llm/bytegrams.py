"""Rolling hashes over UTF-8 bytes and the split of window starts into runs that share a minimizer."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POS_BITS = 24
_POS_MASK = np.uint64((1 << _POS_BITS) - 1)
#: Starts handled at once; longer texts are cut into slices that overlap by window - 1 bytes.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64), so that low bits depend on high ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte, powers of the base, and powers of its inverse modulo 2**64."""
    n = 2 * SLICE + 4096
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    powers = np.full(n, _BASE, dtype=np.uint64)
    powers[0] = 1
    back = np.full(n, inverse, dtype=np.uint64)
    back[0] = 1
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return values, np.multiply.accumulate(powers), np.multiply.accumulate(back)


class Rolled:
    """Prefix sums of one buffer: hash(starts, length) of any substrings in O(1) each."""

    def __init__(self, data: np.ndarray):
        values, powers, self._back = _tables()
        sums = np.empty(len(data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
        self._sums = sums

    def every(self, length: int) -> np.ndarray:
        """Hashes of all substrings of this length, by start."""
        n = len(self._sums) - length
        return mix((self._sums[length:] - self._sums[:n]) * self._back[:n])

    def at(self, starts: np.ndarray, lengths) -> np.ndarray:
        return mix((self._sums[starts + lengths] - self._sums[starts]) * self._back[starts])


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the least key among the next `width` (leftmost on ties of the upper bits)."""
    n = len(keys)
    tagged = (keys & ~_POS_MASK) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = tagged
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return (np.minimum(behind[:last], ahead[width - 1 : width - 1 + last]) & _POS_MASK).astype(np.int64)


def slices(texts: list[bytes], window: int):
    """Batches of (owner, offset, bytes): every window start of every text lies in exactly one of them."""
    batch, size = [], 0
    for owner, text in enumerate(texts):
        starts = len(text) - window + 1
        for at in range(0, max(starts, 0), SLICE):
            part = text[at : at + min(SLICE, starts - at) + window - 1]
            if size + len(part) > 2 * SLICE and batch:
                yield batch
                batch, size = [], 0
            batch.append((owner, at, part))
            size += len(part)
    if batch:
        yield batch


def minimizer_runs(texts: list[bytes], window: int, gram: int) -> dict[str, np.ndarray]:
    """Maximal runs of consecutive window starts whose windows have the same minimizer.

    The minimizer of a window is its q-gram of least hash, so it depends on the window's bytes alone: equal windows,
    wherever they are, lie in runs with an equal q-gram at an equal distance. Each run is (owner, first start, number
    of starts, distance of the q-gram from the first start, hash of the q-gram, hash of the run's whole text).
    """
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("owner", "start", "count", "shift", "gram", "whole")}
    width = window - gram + 1
    for batch in slices(texts, window):
        data = np.frombuffer(b"".join(part for _, _, part in batch), dtype=np.uint8)
        rolled = Rolled(data)
        grams = rolled.every(gram)
        least = sliding_argmin(grams, width)
        sizes = np.array([len(part) for _, _, part in batch])
        bases = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        valid = np.ones(len(data), dtype=bool)
        for base, size in zip(bases, sizes):
            valid[base + size - window + 1 : base + size] = False
        starts = np.flatnonzero(valid[: len(least)])
        chosen = least[starts]
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        count = np.diff(np.append(first, len(starts)))
        begin, place = starts[first], chosen[first]
        which = np.searchsorted(bases, begin, side="right") - 1
        out["owner"].append(np.array([owner for owner, _, _ in batch])[which])
        out["start"].append(begin - bases[which] + np.array([at for _, at, _ in batch])[which])
        out["count"].append(count)
        out["shift"].append(place - begin)
        out["gram"].append(grams[place].view(np.int64))
        out["whole"].append(rolled.at(begin, count + window - 1).view(np.int64))
    empty = np.empty(0, dtype=np.int64)
    return {k: np.concatenate(v) if v else empty for k, v in out.items()}
