"""Alignment of two tokenizers over one text: shared cuts, the token groups between them, and links by overlap."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tiktoken._tiktoken import CoreBPE

from .common import Scratch, sliced, tidy

#: A text is cut where one of these follows other than white space: no token of either vocabulary reaches over it.
CUTS = " \n\t"
_SEGMENTS, _DOUBLE = re.compile(rf"(?<=\S)(?=[{CUTS}])"), re.compile(rf"\s[{CUTS}]|\0")
#: Segments and their tokens that a worker keeps at most. Segments of more characters than the last number are split
#: into pieces here, since the library's pattern matcher has a bounded stack.
_KEPT, _KEPT_TOKENS, _LONG = 400_000, 4_000_000, 2000
#: Counted pairs that every task holds at most, the most frequent ones; the others are joined by a shuffle.
MOST_HELD = 1 << 20
#: Bytes of texts aligned at once.
_AT_ONCE = 1 << 21


class Bits:
    """A packed bitset over byte positions, with ranks by popcount."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def at(cls, positions: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, dtype=bool)
        flags[positions] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def select(self) -> np.ndarray:
        """The positions of all set bits, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """How many bits are set before each position."""
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        word = positions >> 6
        below = (np.uint64(1) << (positions & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(self.words[word] & below)


def _decimal(size: int) -> np.ndarray:
    """Each number's decimal digits in ASCII as the low bytes of a 64-bit number; unused ones are zero."""
    text = b"".join(str(i).encode().ljust(8, b"\0") for i in range(size))
    return np.frombuffer(text, dtype="<u8")


class Known(dict):
    """Numbers of segments, given in the order in which they come, with the ids of each by both vocabularies."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.flat = [np.empty(0, dtype=np.int32)] * 2
        self.at = [np.zeros(1, dtype=np.int64)] * 2

    def __missing__(self, segment: str) -> int:
        self[segment] = number = len(self)
        self.fresh.append(segment)
        return number

    def add(self, side: int, ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        new = np.array(list(chain.from_iterable(ids)), dtype=np.int32)
        self.flat[side] = np.concatenate([self.flat[side], new])
        self.at[side] = np.concatenate([self.at[side], self.at[side][-1] + np.cumsum(lengths)])

    def ids(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these segments, one after another, and how many each has."""
        at = self.at[side]
        lengths = at[numbers + 1] - at[numbers]
        ends = np.cumsum(lengths)
        place = np.repeat(at[numbers] - ends + lengths, lengths)
        place += np.arange(len(place))
        return self.flat[side][place], lengths


class Pair:
    """Two vocabularies: a byte-level one (A) and one of pieces with byte fallback (B), and what is known of texts'
    segments: the ids of both as 32-bit integers."""

    def __init__(self, byte_path: str, piece_path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_path, "rb"))}
        self.core = CoreBPE(ranks, {}, public_tokenizers.PATTERN)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        size = self.pieces.get_piece_size()
        texts = [self.pieces.id_to_piece(i) for i in range(size)]
        plain = [re.fullmatch(r"<0x([0-9A-F]{2})>", t) if self.pieces.is_byte(i) else None for i, t in enumerate(texts)]
        self.of_a: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.of_a[i] = token
        self.of_b = [bytes([int(m[1], 16)]) if m else t.replace("▁", " ").encode() for m, t in zip(plain, texts)]
        self.length_a, self.length_b = (np.array([len(t) for t in of], dtype=np.int64) for of in (self.of_a, self.of_b))
        self.digits_a, self.digits_b = _decimal(len(self.of_a)), _decimal(size)
        self.space = [self.pieces.piece_to_id("▁")]
        # a piece that held one of CUTS after something else could reach over a cut
        self.cuttable = not any(re.search(rf"[^▁](?=▁)|[{CUTS}]", t) for i, t in enumerate(texts) if not self.pieces.is_byte(i))
        self.known = Known()

    def segments(self, text: str) -> list[str]:
        whole = f" {text}"
        if not self.cuttable:
            return [whole]
        if _DOUBLE.search(whole):
            return _SEGMENTS.split(whole)
        for c in CUTS:
            whole = whole.replace(c, f"\0{c}")
        return whole[1:].split("\0")

    def ids_a(self, segment: str) -> list[int]:
        if len(segment) <= _LONG:
            return self.core.encode_ordinary(segment)
        return [i for p in self.split.findall(segment) for i in self.core.encode_single_piece(p.encode())]

    def ids_b(self, segments: list[str]) -> list[list[int]]:
        """The library puts a space before what it encodes: it stands for a segment's own first space, and is taken
        off where a segment begins otherwise."""
        found = self.pieces.encode([s.removeprefix(" ") for s in segments], num_threads=1)
        return [(ids or self.space) if s[0] == " " else ids[1:] for s, ids in zip(segments, found)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By A and by B: the ids of all texts, one after another, and how many each has. A text is preceded by a space."""
        if len(self.known) > _KEPT or len(self.known.flat[0]) > _KEPT_TOKENS:
            self.known = Known()
        known = self.known
        cut = [self.segments(t) for t in texts]
        numbers = np.array(list(map(known.__getitem__, chain.from_iterable(cut))), dtype=np.int64)
        fresh, known.fresh = known.fresh, []
        if fresh:
            known.add(0, [self.ids_a(s) for s in fresh])
            known.add(1, self.ids_b(fresh))
        at = _offsets(np.array([len(x) for x in cut], dtype=np.int64))
        both = [known.ids(side, numbers) for side in range(2)]
        return [(ids, np.diff(_offsets(lengths)[at])) for ids, lengths in both]


@lru_cache(2)
def _pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


class Aligned:
    """The alignment of a batch of texts, over all their bytes at once.

    The ends of A's and of B's tokens are bits at the positions of their last bytes. Bits that are set in both are
    cuts: ranks at them give the token ranges between cuts. Every bit that is set in either ends a stretch of bytes
    that lies in one token of each, and no two stretches in the same two: these are the links.
    """

    def __init__(self, pair: Pair, texts: list[str | None]):
        there = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
        (flat_a, n_a), (flat_b, n_b) = pair.encode([texts[i] for i in there])
        good = self._good(pair, [texts[i] for i in there], flat_a, n_a, flat_b, n_b)
        if not good.all():
            flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
        self.n_a, self.n_b = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        self.n_a[there], self.n_b[there] = n_a * good, n_b * good
        ends_a, ends_b = np.cumsum(pair.length_a[flat_a]) - 1, np.cumsum(pair.length_b[flat_b]) - 1
        size = int(ends_a[-1]) + 1 if len(ends_a) else 0
        set_a, set_b = Bits.at(ends_a, size), Bits.at(ends_b, size)
        cuts, stretches = (set_a & set_b).select(), (set_a | set_b).select()
        last_a, last_b = set_a.rank(cuts), set_b.rank(cuts)  # the tokens that end at each cut
        self.at_a = _offsets(self.n_a)
        document_end = _offsets(np.diff(np.concatenate([[0], ends_a + 1])[self.at_a]))
        self.n_groups = np.diff(np.searchsorted(cuts, document_end))
        self.link_at = np.searchsorted(stretches, document_end)
        self.n_links = np.diff(self.link_at)
        codes = flat_a[set_a.rank(stretches)].astype(np.int64) * len(pair.of_b) + flat_b[set_b.rank(stretches)]
        self.groups = self._written(pair, flat_a, flat_b, last_a, last_b)
        self._counted(codes, len(texts), len(pair.of_a) * len(pair.of_b))

    @staticmethod
    def _good(pair: Pair, texts: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether each text's tokens have the text's own bytes. Other ones come only where a piece stands for more
        than its text: tokens are compared where there is the sign for a space, or another number of bytes."""
        want = np.array([len(t.encode()) + 1 for t in texts], dtype=np.int64)
        good = np.ones(len(texts), dtype=bool)
        for ids, n, length, of in ((a, n_a, pair.length_a, pair.of_a), (b, n_b, pair.length_b, pair.of_b)):
            at = _offsets(n)
            good &= np.diff(_offsets(length[ids])[at]) == want
            for i in (i for i, t in enumerate(texts) if good[i] and ("▁" in t or "�" in t)):
                good[i] = b"".join(of[j] for j in ids[at[i] : at[i + 1]]) == f" {texts[i]}".encode()
        return good

    def _written(self, pair: Pair, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """The digest of each text's groups, written as decimal numbers: every token's place among those of both is
        its own number and that of the other's tokens in groups before (A) or up to its own (B)."""
        group_a = np.searchsorted(last_a, np.arange(len(a)))
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
        place_b = np.arange(len(b)) + (last_a + 1)[group_b] if len(b) else np.arange(0)
        out = np.empty(len(a) + len(b), dtype=np.uint64)
        out[place_a], out[place_b] = pair.digits_a[a], pair.digits_b[b]
        out |= np.uint64(ord(",") << 56)
        for places, mark in ((place_a[last_a], "|"), (place_b[last_b], ";")):
            out[places] ^= np.uint64((ord(",") ^ ord(mark)) << 56)
        out = out.view(np.uint8)
        bounds = 8 * (self.at_a + _offsets(self.n_b))
        digests = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            flat = out[low:high]
            digests.append(hashlib.sha256(flat[flat > 0].tobytes()[:-1]).hexdigest() if high > low else "")
        return digests

    def _counted(self, codes: np.ndarray, documents: int, bound: int) -> None:
        """Each text's distinct linked ids, in order, and how often they are linked in it."""
        owner = np.repeat(np.arange(documents), self.n_links)
        both = np.sort(owner * bound + codes)
        first = np.flatnonzero(np.diff(both, prepend=-1))
        self.codes, self.times = both[first] % bound, np.diff(np.append(first, len(both)))
        self.code_at = np.searchsorted(both[first], np.arange(documents + 1) * bound)


class Counts:
    """How many documents hold each of some pairs linked, and whether that is the most of any pair of its A id."""

    def __init__(self, code: np.ndarray, count: np.ndarray, best: np.ndarray):
        order = np.argsort(code)
        self.code, self.count, self.best = code[order], count[order], best[order]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each code: whether it is here, its count and whether it is its A id's highest (else 0)."""
        if not len(self.code):
            return np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        here = self.code[at] == codes
        return here, np.where(here, self.count[at], 0), np.where(here, self.best[at], 0)


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pa.array(values, type=kind))


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, key: str = "doc_id", column: str = "text", most_held: int = MOST_HELD) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: each text's alignment of two tokenizers.

    byte_path is a file of ranks, piece_path a model of pieces; both must be at the same place on every executor. A
    first pass over the texts writes each row's digest, numbers and distinct linked ids; these are counted over all
    rows (a row is a document, also where keys repeat); a second pass adds up what was counted. Every task holds the
    counts of the most frequent pairs, `most_held` at most; rarer ones, none of which is in more than twice the
    average's share of rows, are joined by a shuffle. Texts are taken whole, however long; what a task holds is one text
    or a batch of two megabytes.

    Null and empty texts, and those whose tokens' bytes aren't the text's (any that holds U+2581), have no tokens:
    zeros and an empty digest. Null keys and repeated rows stay, each as a row. An empty table gives an empty result.
    Columns other than the two, whatever their names, are not read.
    """
    spark = docs.sparkSession
    byte_path, piece_path = byte_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), piece_path or public_tokenizers.path("piece_bpe_32k.model")
    scratch = Scratch(spark, "alignment")
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(f"`{column}`").alias("_text"))
    counted = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    first = StructType([texts.schema["_key"], *StructType.fromDDL(f"_row long, {counted}, _codes array<long>, _times array<int>").fields])
    arrow = to_arrow_schema(first)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_path, piece_path)
        for batch in (p for whole in batches for p in sliced(whole, 2, _AT_ONCE)):
            got = Aligned(pair, batch.column(2).to_pylist())
            columns = [pa.array(c, type=f.type) for c, f in zip((got.n_a, got.n_b, got.n_groups, got.n_links, got.groups), list(arrow)[2:7])]
            columns += [_lists(got.codes, got.code_at, pa.int64()), _lists(got.times, got.code_at, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(c.cast(f.type) for c, f in zip(columns, list(arrow)[2:]))], schema=arrow)

    rows = scratch.save(texts.mapInArrow(tidy(aligned), first), "rows")
    pieces = len(_pair(byte_path, piece_path).of_b)
    counts = scratch.save(rows.select(F.explode("_codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("documents")), "documents", light=True)
    of_a = F.floor(F.col("code") / pieces)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("documents").alias("most"))
    marked = scratch.save(counts.withColumn("a", of_a).join(most, "a").select("code", "documents", (F.col("documents") == F.col("most")).cast("int").alias("best")), "counts", light=True)
    # the least power of two from which on the counts are few enough to be held
    sizes = {r["k"]: r["n"] for r in marked.groupBy(F.floor(F.log2("documents")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = next(k for k in range(66) if sum(n for j, n in sizes.items() if j >= k) <= most_held)
    held = marked.where(F.col("documents") >= F.lit(1 << least if least < 63 else (1 << 63) - 1)).toPandas()
    shared = spark.sparkContext.broadcast(Counts(*(held[c].to_numpy(dtype=np.int64) for c in ("code", "documents", "best"))))
    names = [f"`{key}`", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    second = StructType([*first.fields[:7], *StructType.fromDDL("n_best long, count_sum long, _codes array<long>, _times array<int>").fields])
    arrow_second = to_arrow_schema(second)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            codes, times = batch.column(7), batch.column(8)
            at = codes.offsets.to_numpy() - codes.offsets[0].as_py() if len(codes) else np.zeros(1, dtype=np.int64)
            flat, repeated = codes.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            here, number, best = counts.find(flat)
            sums = [np.diff(_offsets(v)[at]) for v in (repeated * best, repeated * number)]
            left = _offsets(~here)[at]
            rest = [_lists(flat[~here], left, pa.int64()), _lists(times.flatten().to_numpy()[~here], left, pa.int32())]
            columns = [*batch.columns[:7], *(pa.array(s, type=pa.int64()) for s in sums), *rest]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_second)], schema=arrow_second)

    summed = rows.mapInArrow(tidy(added), second)
    if least == 0:
        return scratch.only(summed.withColumnRenamed("_key", key).select(*names))
    summed = scratch.save(summed, "summed")
    each = summed.select("_row", F.explode(F.arrays_zip("_codes", "_times")).alias("x")).select("_row", F.col("x._codes").alias("code"), F.col("x._times").alias("times"))
    rare = marked.where(F.col("documents") < F.lit(1 << least)).withColumnRenamed("documents", "number")
    rest = each.join(rare, "code").groupBy("_row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("number")).alias("more_sum"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    whole = summed.drop("_codes", "_times").join(rest, "_row", "left").withColumnRenamed("_key", key)
    return scratch.only(whole.select(*names[:5], plus("n_best", "more_best"), plus("count_sum", "more_sum"), names[7]))
