"""Document fingerprints from prefix polynomial hashes, and how alike two of them are."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bytegrams import mix
from .common import _small_batches, sliced, tidy

#: The prime 2 ** 31 - 1 and two bases: hashes are pairs of remainders of polynomials in them. Fixed values.
PRIME = (1 << 31) - 1
BASES = (1000003579, 1500450271)
#: Code points of a span whose hash can enter the sketch, hashes of a sketch, and checkpoints from either end at most.
SPAN, SKETCH, CHECKS = 24, 64, 32
#: Code points hashed at once.
BLOCK = 1 << 16
#: Bytes of texts hashed together; a longer one comes alone.
_AT_ONCE = 1 << 20
_P, _BITS, _ODD = np.uint64(PRIME), np.uint64(31), np.uint64(0x9E3779B97F4A7C15)


def _fold(x: np.ndarray) -> np.ndarray:
    """Numbers with the same remainder and half the bits, as 2 ** 31 leaves 1: below 2 ** 33 from below 2 ** 64."""
    return (x & _P) + (x >> _BITS)


def _rest(x: np.ndarray) -> np.ndarray:
    """Remainders."""
    x = _fold(_fold(x))
    return np.minimum(x, x - _P)  # below zero wraps around


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, in order."""
    x = np.sort(x)
    return x[np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))] if len(x) else x


def _powers(base: int) -> np.ndarray:
    """base ** i for i from 0 to BLOCK, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) <= BLOCK:
        out = np.concatenate([out, _rest(out * np.uint64(pow(base, len(out), PRIME)))])
    return out[: BLOCK + 1]


_POWERS = [_powers(b) for b in BASES]
_BACK = [_powers(pow(b, -1, PRIME)) for b in BASES]


def _power(k: int, lengths: np.ndarray) -> np.ndarray:
    """The base to these powers; those beyond the table's are few."""
    most = len(_POWERS[k]) - 1
    out = _POWERS[k][np.minimum(lengths, most)]
    for i in np.flatnonzero(lengths > most):
        out[i] = pow(BASES[k], int(lengths[i]), PRIME)
    return out


def _less(end: np.ndarray, start: np.ndarray, power) -> np.ndarray:
    """The hash of a span from those of the prefixes that end with it and before it."""
    return _rest(end + _P - _rest(start * power))


def _mixed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """32 bits of two remainders, as evenly spread as a sketch needs."""
    return ((one << _BITS | two) * _ODD >> np.uint64(32)).astype(np.uint32)


def _step(n: int) -> int:
    """The least power of two that n holds CHECKS times at most."""
    return 1 << max((n - 1) // CHECKS, 0).bit_length() if n else 1


class Hashed:
    """Prefix hashes, in both bases, of some texts one after another, and the hashes of all their spans of SPAN code
    points.

    A prefix's hash is the polynomial of its code points (each plus one) in the base, the last one being the constant
    term. So the span from i to j has the hash h[j] - h[i] * base ** (j - i), whatever stands before it.
    """

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.lows = np.cumsum(self.lengths) - self.lengths
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(points)
        self.h = [np.zeros(n + 1, dtype=np.uint32) for _ in BASES]
        self.grams = np.empty(max(n - SPAN + 1, 0), dtype=np.uint32)
        for at in range(0, n, BLOCK):
            part = points[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
            for k, out in enumerate(self.h):
                # sums of c[i] / base ** (i + 1), then times base ** (number so far)
                sums = np.cumsum(_fold(part * _BACK[k][1 : len(part) + 1])) + np.uint64(int(out[at]))
                out[at + 1 : at + 1 + len(part)] = _rest(_fold(sums) * _POWERS[k][1 : len(part) + 1])
        for at in range(0, len(self.grams), BLOCK):
            high = min(at + BLOCK, len(self.grams))
            both = [_less(h[at + SPAN : high + SPAN].astype(np.uint64), h[at:high].astype(np.uint64), _POWERS[k][SPAN]) for k, h in enumerate(self.h)]
            self.grams[at:high] = _mixed(*both)

    def raw(self, k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hashes of spans in one base."""
        h = self.h[k]
        return _less(h[high].astype(np.uint64), h[low].astype(np.uint64), _power(k, high - low))

    def whole(self) -> Spliced:
        """The texts themselves."""
        return Spliced(self, self.lows, self.lengths, self.lows, np.zeros_like(self.lengths))


class Spliced:
    """Texts that are each the first `keep` code points of one hashed text, from `low` on, and the first `take` of
    another, from `other` on. Nothing is hashed anew but the spans that lie across a seam."""

    def __init__(self, hashed: Hashed, low: np.ndarray, keep: np.ndarray, other: np.ndarray, take: np.ndarray):
        self.hashed, self.low, self.keep, self.other, self.take = hashed, low, keep, other, take
        self.n = keep + take

    def raw(self, k: int, of: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes in one base of spans, each of the text of a number."""
        low, keep, other = self.low[of], self.keep[of], self.other[of]
        before = self.hashed.raw(k, low + np.minimum(starts, keep), low + np.minimum(ends, keep))
        first, last = np.maximum(starts - keep, 0), np.maximum(ends - keep, 0)
        return _rest(before * _power(k, last - first) + self.hashed.raw(k, other + first, other + last))

    def spans(self, of: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans. Equal spans, of any texts, have equal ones."""
        return mix(self.raw(0, of, starts, ends) << np.uint64(32) | self.raw(1, of, starts, ends))

    def common(self, one: int, start: int, two: int, at: int) -> int:
        """The length of the longest span that begins at `start` in one text and at `at` in another, by binary search."""
        low, high = 0, int(min(self.n[one] - start, self.n[two] - at))
        while low < high:
            half = (low + high + 1) // 2
            a, b = self.spans(np.array([one, two]), np.array([start, at]), np.array([start + half, at + half]))
            low, high = (half, high) if a == b else (low, half - 1)
        return low

    def grams(self) -> list[list[np.ndarray]]:
        """Of each text the 32-bit hashes of all spans of SPAN code points, in parts; of a shorter text that of the
        whole, of an empty one none."""
        own, other = np.maximum(self.keep - SPAN + 1, 0), np.maximum(self.take - SPAN + 1, 0)
        count = np.where(self.n >= SPAN, np.minimum(self.keep, self.n - SPAN + 1) - own, np.minimum(self.n, 1)).clip(0)
        count[(self.take == 0) & (self.n >= SPAN)] = 0
        of = np.repeat(np.arange(len(self.n)), count)
        cut = np.cumsum(count)
        starts = np.where(self.n >= SPAN, own, 0)[of] + np.arange(len(of)) - (cut - count)[of]
        across = _mixed(*(self.raw(k, of, starts, starts + np.minimum(self.n, SPAN)[of]) for k in range(2)))
        return [[self.hashed.grams[a : a + x], across[c - m : c], self.hashed.grams[b : b + y]] for a, x, c, m, b, y in zip(*(v.tolist() for v in (self.low, own, cut, count, self.other, other)))]

    def fingerprints(self) -> list[str]:
        """Of each text its length, its whole hash, hashes of its beginnings and of its ends at multiples of a step, and
        the least hashes of its spans of SPAN code points (of the whole text, if that is shorter), as hexadecimal words.

        The step is the least power of two that the text holds CHECKS times at most. Texts that are equal, and only
        those but for chance, have the same.
        """
        lengths = self.n.tolist()
        steps = np.array([_step(n) for n in lengths], dtype=np.int64)
        count = self.n // steps
        of = np.repeat(np.arange(len(lengths)), count)
        cut = np.cumsum(count)
        marks = steps[of] * (1 + np.arange(len(of)) - (cut - count)[of])
        zeros, every = np.zeros(len(marks), dtype=np.int64), np.arange(len(lengths))
        hashes = self.spans(np.concatenate([every, of, of]), np.concatenate([0 * self.n, zeros, self.n[of] - marks]), np.concatenate([self.n, marks, self.n[of]]))
        words = (hashes >> np.uint64(32)).astype(">u4").tobytes()
        m = len(lengths)
        sides = words[4 * m :].hex()
        out = []
        for n, whole, c, k, parts in zip(lengths, hashes[:m].tolist(), cut.tolist(), count.tolist(), self.grams()):
            sketch = _sketch(parts).astype(">u4").tobytes().hex()
            out.append(f"{n:x}.{whole:016x}.{sides[8 * (c - k) : 8 * c]}.{sides[8 * (len(of) + c - k) : 8 * (len(of) + c)]}.{sketch}")
        return out


def _sketch(parts: list[np.ndarray]) -> np.ndarray:
    """The least distinct hashes: of many, those below a bound that leaves some more than are wanted."""
    n = sum(map(len, parts))
    if n > 16 * SKETCH:
        bound = np.uint32((1 << 32) * 4 * SKETCH // n)
        least = _distinct(np.concatenate([p[p < bound] for p in parts]))
        if len(least) >= SKETCH:
            return least[:SKETCH]
    return _distinct(np.concatenate(parts))[:SKETCH]


def _shared(one: str, two: str, step: int, other: int) -> int:
    """Code points that two texts have in common from one end, as far as their checkpoints tell: by binary search, as
    beginnings are equal up to some length and unequal from then on."""
    wide = max(step, other)
    a, b = 8 * (wide // step), 8 * (wide // other)
    low, high = 0, min(len(one) // a, len(two) // b)
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if one[half * a - 8 : half * a] == two[half * b - 8 : half * b] else (low, half - 1)
    return low * wide


def likeness(one: str, two: str) -> float:
    """How alike the texts of two fingerprints are, from 0 to 1: equal ones 1, an empty and another one 0.

    The larger of two estimates: the share of the longer text that lies before the first and after the last difference,
    and the resemblance of the sets of spans (common ones by all), from the least hashes of both together.
    """
    if one == two:
        return 1.0
    a, b = one.split("."), two.split(".")
    n, m = int(a[0], 16), int(b[0], 16)
    if not n or not m:
        return 0.0
    begin, end = (_shared(a[i], b[i], _step(n), _step(m)) for i in (2, 3))
    ends = min(begin + end, n, m) / max(n, m)
    s, t = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (a[4], b[4]))
    least = sorted(s | t)[:SKETCH]
    return max(ends, sum(x in s and x in t for x in least) / len(least))


def compare(texts: list[str]) -> list[tuple]:
    """Of every text but the last: its length, the digest of its edited text (whose last third is the beginning of the
    next text), both fingerprints, and the likeness of its own to that one and to the next text's."""
    hashed = Hashed(texts)
    prints = hashed.whole().fingerprints()
    n, low = hashed.lengths, hashed.lows
    taken = n[:-1] // 3
    edits = Spliced(hashed, low[:-1], n[:-1] - taken, low[1:], np.minimum(taken, n[1:]))
    out = []
    for i, edited in enumerate(edits.fingerprints()):
        whole = texts[i][: edits.keep[i]] + texts[i + 1][: edits.take[i]]
        digest = hashlib.sha256(whole.encode("utf-8")).hexdigest()
        out.append((int(n[i]), digest, prints[i], edited, likeness(prints[i], edited), likeness(prints[i], prints[i + 1])))
    return out


_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every text.

    The edited text ends with the beginning of the next document's text in place of its last third; documents follow
    one another by descending key, and the first follows the last. Rows are dealt into ranges of keys, one for each
    shuffle partition; the first document of each range, whose key all tasks know, goes to the range before it too. So
    texts are shuffled once, and a task holds two of them, or batches of a megabyte, with their arrays (12 bytes
    for each code point), however many a range has. Bounds of ranges come from the keys alone.

    Null texts are empty. Rows of null key come last; rows that share a key follow one another by a hash of their texts,
    so that equal rows have equal neighbours wherever they stand, and ranges divide them too. A single document follows
    itself. Very long texts are hashed block by block. An empty table gives an empty result; columns other than the
    two, whatever their names, are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("_text"))
    order = ["_null", "_turned", "_hash", "_row"]
    ordered = named.select("_key", "_text", F.col("_key").isNull().alias("_null"), F.coalesce(F.bitwise_not("_key"), F.lit(0)).alias("_turned"), F.xxhash64("_text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    # each range's first key; a bound on keys alone wouldn't divide the rows of one key
    ranges = ordered.select(*order).repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("_part")).agg(F.min(F.struct(*order)).alias("first"))
    bounds = sorted(tuple(r["first"]) for r in ranges.select("first").collect())
    schema = StructType.fromDDL(f"_key long, {_SCHEMA}")
    if not bounds:
        return spark.createDataFrame([], StructType.fromDDL(f"`{key}` long, {_SCHEMA}"))
    turned = [b[1] for b in bounds if not b[0]]

    @F.pandas_udf("array<int>")
    def places(null: pd.Series, own: pd.Series, hashed: pd.Series, row: pd.Series) -> pd.Series:
        """The range of each row, and for a range's first row the one before it too, as -1 - number."""
        low, high = np.searchsorted(turned, own, side="left"), np.searchsorted(turned, own, side="right")
        sure = ~null.to_numpy() & (low == high)
        out = []
        for certain, at, x in zip(sure.tolist(), low.tolist(), zip(null.tolist(), own.tolist(), hashed.tolist(), row.tolist())):
            at = at - 1 if certain else bisect_right(bounds, x) - 1
            first = not certain and bisect_left(bounds, x) == at
            out.append([at, -1 - (at - 1) % len(bounds)] if first else [at])
        return pd.Series(out)

    arrow = to_arrow_schema(schema)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's rows in order; a last one, which is the next range's first, is not of the range."""
        keys, texts = [], []
        for batch in (p for whole in batches for p in sliced(whole, 1, _AT_ONCE)):
            keys, texts = [*keys[-1:], *batch.column(0).to_pylist()], [*texts[-1:], *batch.column(1).to_pylist()]
            if rows := compare(texts):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip([keys[:-1], *zip(*rows)], arrow)], schema=arrow)

    _small_batches(spark)
    placed = ordered.withColumn("_place", F.explode(places(*order)))
    dealt = placed.withColumn("_guest", F.col("_place") < 0).withColumn("_range", F.when(F.col("_place") < 0, -1 - F.col("_place")).otherwise(F.col("_place")))
    sorted_ = dealt.repartitionById(len(bounds), "_range").sortWithinPartitions("_guest", *order)
    found = sorted_.select("_key", "_text").mapInArrow(tidy(compared), schema)
    return found.withColumnRenamed("_key", key)
