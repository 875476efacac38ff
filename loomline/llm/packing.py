"""Packing of tokenised documents into sequences by bulk-synchronous best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sliced, tidy
from .tokens import Encoder, unsafe_ids

CAPACITY = 4096
#: Ranks of one length that are placed together, and rows of one length that are numbered by one task.
BLOCK, PART = 4096, 1000
END_ID = (1).to_bytes(4, "little")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only where longer than capacity."""
    unsafe = unsafe_ids(path)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, unsafe).encode
        for batch in (p for whole in batches for p in sliced(whole, 1)):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + END_ID
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with `rank`, from 0 without gaps within each length. counts: (length, n).

    Each length is dealt out by a hash of doc_id over as many parts as it has PART rows, numbered inside a part, and
    raised by the sizes of the parts before it, so that no length has to be sorted in one task.
    """
    parts = F.greatest(F.ceil(F.col("n") / PART), F.lit(1))
    salted = rows.join(F.broadcast(counts.select("length", parts.alias("parts"))), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts"))).drop("parts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    return salted.withColumn("inner", inner).join(sizes.drop("n"), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("inner")).drop("base", "inner", "salt")


class Gaps:
    """Free ends of sequences: for each size, runs (first sequence, how many)."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, size: int, first: int, many: int) -> None:
        if not size or not many:
            return
        if size not in self.runs:
            insort(self.sizes, size)
            self.runs[size] = []
        own = self.runs[size]
        if own and sum(own[-1]) == first:
            first, many = own[-1][0], own.pop()[1] + many
        own.append((first, many))

    def successor(self, length: int) -> tuple[int, int, int] | None:
        """The smallest size that holds the length, with a run of it, which is taken out; None where there is none."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        run = self.runs[size].pop()
        if not self.runs[size]:
            del self.runs[size], self.sizes[at]
        return size, *run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where ranks of each length go: (length, first rank, how many, how many a sequence, first sequence, offset).

    One bulk step a length, the longest first: its documents, in order of rank, go to the gaps that are their
    successors in size, as many to a gap as it holds; gaps are updated, sequences are opened where no gap holds the
    length, and the next length follows. Documents of a length are alike, and so are gaps of a size, so a step runs
    over runs of gaps and not over documents, and gives what best fit gives that takes documents one by one.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    gaps, opened = Gaps(), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = gaps.successor(length)
            if found is None:
                size, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            else:
                size, first, many = found
            each = size // length
            full = min(many, left // each)
            last = min(left - full * each, each) if many > full else 0
            for n, inside in ((full, each), (int(last > 0), last)):
                if n:
                    slots.append((length, rank, n * inside, inside, first, capacity - size))
                    gaps.put(size - inside * length, first, n)
                    rank, left, first, many = rank + n * inside, left - n * inside, first + n, many - n
            gaps.put(size, first, many)
    return slots


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Repeated rows are packed as often as they occur. An empty
    table gives an empty result; extra columns are ignored. What reaches the driver is one count for each length, of
    which there are at most `capacity`; what goes back is the plan's runs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    rows = scratch.save(pieces(docs, path, capacity), "pieces")
    counts = scratch.save(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "counts")
    slots = pd.DataFrame(plan({r["length"]: r["n"] for r in counts.collect()}, capacity), columns=["length", "first", "many", "each", "sequence", "at"], dtype=np.int64)
    runs = spark.createDataFrame(slots, "length long, first long, many long, each long, sequence long, at long")
    blocks = F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("many") - 1) / BLOCK))
    runs = runs.withColumn("block", F.explode(blocks))
    dealt = ranked(rows, counts).withColumn("block", F.floor(F.col("rank") / BLOCK))
    placed = dealt.join(runs, ["length", "block"]).where("rank >= first and rank < first + many")
    place = F.col("rank") - F.col("first")
    sequence, offset = F.col("sequence") + F.floor(place / F.col("each")), F.col("at") + place % F.col("each") * F.col("length")
    return scratch.only(placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset")))
