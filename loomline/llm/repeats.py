"""Removal of long repeated byte strings by bucket-pointer refinement, in buckets of sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrams import SLICE, Rolled, minimizer_runs
from .common import Scratch, sliced, tidy

#: Length of a string that must not repeat, and of the q-grams of the initial buckets.
WINDOW, GRAM = 200, 64
#: Distinct strings of a bucket that one task refines in memory; larger buckets are refined by shuffled hashes.
MOST = 2000
#: Bytes of the first buckets inside a task.
Q = 5
_KEY = "key long, mark long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and mark (two hashes, which tell rows of one doc_id apart by 128 bits of their texts) and text, null as
    empty. Rows that are equal in both columns have the same key and mark, and the same result."""
    text = F.coalesce("text", F.lit(""))
    number = F.col("doc_id").cast("long")
    return docs.select(number.alias("doc_id"), F.xxhash64(number, text).alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _packed(start: np.ndarray, count: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 16) | (count.astype(np.int64) << 8) | shift.astype(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def initial_buckets(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, mark, place, bucket, whole: each document's window starts in runs with one minimizer.

    `bucket` is the hash of the run's q-gram, `whole` of all bytes that its windows cover, `place` packs first start,
    number of starts and the q-gram's distance. Equal windows lie in runs of one bucket at one distance, so only runs
    of a bucket need comparing: some 15 for a thousand bytes instead of a thousand suffixes.
    """
    schema = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("place", pa.int64()), ("bucket", pa.int64()), ("whole", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in sliced(whole, 2)):
            runs = minimizer_runs(_texts(batch.column(2)), window, gram)
            owner = pa.array(runs["owner"].astype(np.int64))
            place = _packed(runs["start"], runs["count"], runs["shift"])
            columns = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(place), pa.array(runs["gram"]), pa.array(runs["whole"])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("key", "mark", "text").mapInArrow(tidy(split), f"{_KEY}, place long, bucket long, whole long")


def contents(rows: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """The bytes of runs: `wanted` has key, mark and runs, an array of (place, bucket, part, single)."""
    schema = "key long, mark long, place long, bucket long, part int, single boolean, data binary"
    arrow = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("place", pa.int64()), ("bucket", pa.int64()), ("part", pa.int32()), ("single", pa.bool_()), ("data", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in sliced(whole, 2)):
            runs = batch.column(3)
            flat = runs.flatten()
            owner = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy(zero_copy_only=False))
            place = flat.field(0).to_numpy()
            start, count = place >> 16, (place >> 8) & 255
            texts = _texts(batch.column(2))
            data = [texts[o][s : s + n] for o, s, n in zip(owner.tolist(), start.tolist(), (count + window - 1).tolist())]
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(flat.field(i) for i in range(4)), pa.array(data, type=pa.binary())], schema=arrow)

    return rows.select("key", "mark", "text").join(wanted, ["key", "mark"]).select("key", "mark", "text", "runs").mapInArrow(tidy(cut), schema)


def _windows(data: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of each string, the string's number, and the offset in it."""
    hashes, numbers, offsets = [], [], []
    at = 0
    while at < len(data):
        size, end = 0, at
        while end < len(data) and (size + len(data[end]) <= SLICE or end == at):
            size += len(data[end])
            end += 1
        lengths = np.array([len(d) for d in data[at:end]])
        every = Rolled(np.frombuffer(b"".join(data[at:end]), dtype=np.uint8)).every(window)
        counts = lengths - window + 1
        bases = np.cumsum(lengths) - lengths
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes.append(every[np.repeat(bases, counts) + inner])
        numbers.append(np.repeat(np.arange(at, end), counts))
        offsets.append(inner)
        at = end
    return np.concatenate(hashes), np.concatenate(numbers), np.concatenate(offsets)


def refined(data: list[bytes], buckets: np.ndarray, shift: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every window that occurs twice among the strings of a bucket, by bucket-pointer refinement.

    Strings of a bucket are aligned at its q-gram, so windows can only be equal at one place of the alignment. Suffixes
    are first put into buckets by place and Q bytes. Then buckets are refined by sorting on pairs of bucket identifiers,
    a suffix's own and that of the suffix as many bytes later as its bucket is deep: identifiers of one round are the
    keys of the next, so depth doubles, and the last round reaches just `window` bytes. Suffixes alone in their bucket
    drop out of all later rounds. Bytes are compared and no hashes, so no two different windows are taken for equal.
    """
    lengths = np.array([len(d) for d in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    base = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(data)), lengths)
    inner = np.arange(len(flat)) - base[owner]
    left = lengths[owner] - inner
    depth = min(Q, window)
    at = np.flatnonzero(left >= depth)
    _, bucket = np.unique(buckets, return_inverse=True)
    place = inner[at] - shift[owner[at]]
    key = bucket.ravel()[owner[at]] * np.int64(place.max(initial=0) - place.min(initial=0) + 1) + place - place.min(initial=0)
    for k in range(depth):
        if k and k % 2 == 0:
            key = np.unique(key, return_inverse=True)[1].ravel()
        key = key << 8 | flat[at + k]
    ids = np.full(len(flat) + 1, -1, dtype=np.int64)

    def put(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        number = number.ravel()
        often = count[number] > 1
        ids[:] = -1
        ids[at[often]] = number[often]
        return at[often]

    at = put(at, key)
    while depth < window:
        step = min(depth, window - depth)
        at = at[left[at] >= depth + step]
        at = at[ids[at + step] >= 0]
        at = put(at, ids[at] * np.int64(len(flat) + 1) + ids[at + step])
        depth += step
    return owner[at], inner[at]


def _spans(batch: pa.Table, window: int) -> pa.RecordBatch:
    """Runs of starts, in strings that are single, whose windows occur twice in this batch of whole buckets."""
    column = lambda c: batch.column(c).combine_chunks()
    place = column("place").to_numpy()
    numbers, offsets = refined(column("data").to_pylist(), column("bucket").to_numpy(), place & 255, window)
    wanted = column("single").to_numpy(zero_copy_only=False)[numbers]
    numbers, offsets = numbers[wanted], offsets[wanted]
    first = np.flatnonzero((np.diff(offsets, prepend=-2) != 1) | (np.diff(numbers, prepend=-1) != 0))
    count = np.diff(np.append(first, len(numbers)))
    owner = numbers[first]
    start = (place >> 16)[owner] + offsets[first]
    take = pa.array(owner)
    key = [column(c).take(take) for c in ("key", "mark")]
    return pa.RecordBatch.from_arrays([*key, pa.array((start.astype(np.int64) << 16) | count)], schema=_SPAN)


_SPAN = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("span", pa.int64())])
_SPAN_DDL = f"{_KEY}, span long"


def refine_in_memory(strings: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans of repeated starts of single strings, bucket by bucket; a bucket has at most MOST strings."""

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < MOST:
                continue
            whole = pa.Table.from_batches(held)
            buckets = whole.column("bucket").to_numpy()
            cut = int(np.searchsorted(buckets, buckets[-1]))
            if cut:
                yield _spans(whole.slice(0, cut), window)
            held, size = whole.slice(cut).to_batches(), whole.num_rows - cut
        if size:
            yield _spans(pa.Table.from_batches(held), window)

    dealt = strings.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(refined), _SPAN_DDL)


def refine_by_hash(strings: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """The same for buckets of any size: windows become rows, counted by hash with partial sums before the shuffle."""
    arrow = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("span", pa.int64()), ("bucket", pa.int64()), ("hash", pa.int64()), ("single", pa.bool_())])

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                hashes, numbers, offsets = _windows(batch.column("data").to_pylist(), window)
                start = (batch.column("place").to_numpy() >> 16)[numbers] + offsets
                take = pa.array(numbers)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(take), batch.column("mark").take(take), pa.array((start.astype(np.int64) << 16) | 1), batch.column("bucket").take(take), pa.array(hashes.view(np.int64)), batch.column("single").take(take)],
                    schema=arrow,
                )

    rows = strings.mapInArrow(tidy(exploded), f"{_SPAN_DDL}, bucket long, hash long, single boolean")
    saved = scratch.save(rows, "windows")
    twice = saved.groupBy("bucket", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "hash")
    return saved.where("single").join(twice, ["bucket", "hash"], "left_semi").select("key", "mark", "span")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """key, mark, spans: for each document that has any, its runs of starts of repeated windows.

    1. Buckets: runs of window starts, by their minimizer q-gram; buckets of one run are dropped.
    2. Refinement by the hash of the whole run: runs that are equal in full are repeated in full, and one of them
       stands for all in what follows.
    3. Refinement of what still differs in a bucket: the bytes of the distinct runs are fetched, and their suffixes
       refined by the bucket identifiers of later offsets. That is done in memory for buckets up to `most`; windows of
       larger ones get hashes for identifiers, and buckets are counted by a shuffle.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = keyed(docs)
    buckets = scratch.save(initial_buckets(rows, window, gram), "buckets")
    # a table of its own, so that a bucket with a large share of the rows can be split in the join
    several = scratch.save(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "several")
    shared = scratch.save(buckets.join(several, "bucket", "left_semi"), "shared")
    scratch.drop("buckets")
    kinds = shared.groupBy("bucket", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "mark", "place")).alias("one"))
    kinds = scratch.save(kinds, "kinds")
    span = F.shiftleft(F.shiftright("place", 16), 16).bitwiseOR(F.shiftright("place", 8).bitwiseAND(F.lit(255)))
    equal = shared.join(kinds.where("n > 1").select("bucket", "whole"), ["bucket", "whole"], "left_semi").select("key", "mark", span.alias("span"))
    mixed = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    wanted = kinds.join(mixed, "bucket").select("one.*", "bucket", (F.col("k") > most).cast("int").alias("part"), (F.col("n") == 1).alias("single"))
    wanted = wanted.groupBy("key", "mark").agg(F.collect_list(F.struct("place", "bucket", "part", "single")).alias("runs"))
    strings = scratch.save(contents(rows, wanted, window), "strings")
    spans = equal.unionByName(refine_in_memory(strings.where("part = 0"), window)).unionByName(refine_by_hash(strings.where("part = 1"), scratch, window))
    return scratch.only(spans.groupBy("key", "mark").agg(F.collect_list("span").alias("spans")))


def covered(size: int, spans: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which bytes the windows of the spans' starts cover."""
    start, count = spans >> 16, spans & 65535
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + count + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of each row.

    Every byte is removed that a string of `window` bytes covers which also starts anywhere else, in any document or
    in the same one. Strings are judged on the input. Null and empty texts have nothing to remove; texts shorter than
    the window stay whole; equal texts remove each other whole; rows that are repeated count as two documents.
    """
    rows = keyed(docs)
    spans = repeated_spans(docs, window, gram, most)
    joined = rows.join(spans, ["key", "mark"], "left").select("doc_id", "text", "spans")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in sliced(whole, 1)):
            out = []
            for text, found in zip(_texts(batch.column(1)), batch.column(2)):
                removed = n = 0
                if found.is_valid:
                    mask = covered(len(text), found.values.to_numpy(), window)
                    removed, n = int(mask.sum()), int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0])
                    kept = np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()
                else:
                    kept = text
                out.append((len(text), removed, n, kept, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*out), list(arrow)[1:])] if out else [pa.array([], type=f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    return joined.mapInArrow(tidy(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
