"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found by cell bounds first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a cell's number: each coordinate of the entries is cut into 2 ** CELL_BITS cells.
CELL_BITS = 4
#: Components beyond this count as this, so that squared distances of up to 4096 of them fit 64 bits.
LARGEST = 1 << 24
#: Rows that are compared at once, and labels whose sums are broadcast at most.
BATCH, MOST_BROADCAST = 2048, 100_000


class Cells:
    """A codebook's entries (part, entry, position) with their coordinates quantised into cells.

    A cell of a coordinate is the range of the entries' values that fall into it. For a query, a table of each
    coordinate's squared distances to the near and the far end of every cell gives, summed over an entry's cells, a
    lower and an upper bound of its distance. Entries whose lower bound is above the least upper bound can't be the
    nearest; the distances of the others are computed from the integers themselves.
    """

    def __init__(self, book: np.ndarray, bits: int = CELL_BITS):
        self.book = book
        parts, entries, width = book.shape
        cells = 1 << bits
        order = np.sort(book, axis=1)
        # edges at equal shares of the sorted values: cell c begins at the value of that rank
        edges = order[:, (np.arange(cells) * entries) // cells, :] if entries else np.zeros((parts, cells, width), dtype=np.int64)
        self.cell = np.empty(book.shape, dtype=np.int64)
        self.low, self.high = np.zeros((parts, width, cells), dtype=np.int64), np.zeros((parts, width, cells), dtype=np.int64)
        for p in range(parts):
            for j in range(width):
                at = np.searchsorted(edges[p, :, j], book[p, :, j], side="right") - 1
                self.cell[p, :, j] = at
                for c in np.unique(at):
                    inside = book[p, at == c, j]
                    self.low[p, j, c], self.high[p, j, c] = inside.min(), inside.max()

    def nearest(self, part: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each query (the first of equally near ones) and its squared distance."""
        n, width = queries.shape
        entries = self.book.shape[1]
        lower, upper = np.zeros((n, entries), dtype=np.int64), np.zeros((n, entries), dtype=np.int64)
        for j in range(width):
            below, above = self.low[part, j][None, :] - queries[:, j, None], queries[:, j, None] - self.high[part, j][None, :]
            near = np.maximum(np.maximum(below, above), 0) ** 2
            far = np.maximum(np.abs(below), np.abs(above)) ** 2
            lower += near[:, self.cell[part, :, j]]
            upper += far[:, self.cell[part, :, j]]
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        distance = ((queries[row] - self.book[part, entry]) ** 2).sum(axis=1)
        first = np.searchsorted(row, np.arange(n))
        least = np.minimum.reduceat(distance, first) if n else np.empty(0, dtype=np.int64)
        hit = np.flatnonzero(distance == least[row])
        chosen = hit[np.searchsorted(row[hit], np.arange(n))]
        return entry[chosen], least

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, part) nearest entries and squared distances."""
        parts, _, width = self.book.shape
        index, far = np.empty((len(vectors), parts), dtype=np.int64), np.empty((len(vectors), parts), dtype=np.int64)
        for p in range(parts):
            index[:, p], far[:, p] = self.nearest(p, vectors[:, p * width : (p + 1) * width])
        return index, far


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """Rows of one length, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == size).all():
        return flat.reshape(len(column), size)
    out = np.zeros((len(column), size), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def integers(vectors: DataFrame, key: str, column: str, label: str) -> DataFrame:
    """key, label and the components as integers, of rows whose vector is not null and holds only finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    there = vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").alias("_label"), F.col(f"`{column}`").cast("array<double>").alias("_vector"))
    return there.where(F.col("_vector").isNotNull() & F.forall("_vector", finite)).select("_key", "_label", F.transform("_vector", whole).alias("_ints"))


def _sums(rows: DataFrame, cells: Cells, size: int) -> dict[tuple[int, int, int], int]:
    """By (part, entry, position): the sum of the parts nearest to the entry; position -1 has their number. Every task
    gives its own sums; what reaches the driver is as large as the codebooks."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("value", pa.int64())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = cells.book.shape
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                vectors = _matrix(batch.slice(at, BATCH).column(0), size)
                index, _ = cells.assign(vectors)
                for p in range(parts):
                    np.add.at(total[p], index[:, p], np.concatenate([vectors[:, p * width : (p + 1) * width], np.ones((len(vectors), 1), dtype=np.int64)], axis=1))
        used = np.argwhere(total[:, :, -1] > 0)
        part, entry = np.repeat(used, width + 1, axis=0).T
        position = np.tile(np.append(np.arange(width), -1), len(used))
        value = total[part, entry, position]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((part, entry, position, value), schema)], schema=schema)

    partial = rows.select("_ints").mapInArrow(tidy(summed), "part int, entry int, position int, value long")
    whole = partial.groupBy("part", "entry", "position").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return {(r["part"], r["entry"], r["position"]): int(r["value"]) for r in whole.collect()}


def encode(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error, codebooks_sha256: the vectors cut into 16 parts, each coded by its codebook.

    Every component becomes floor(256 * x). A part position's codebook begins as that part of the 64 rows of smallest
    key, and is refined twice over all rows; what is held of it, on the driver and by tasks, is 64 times the length of
    a vector. Nearest entries are found by the bounds of Cells and compared as integers, ties going to the lower one.

    Rows whose vector is null or holds null, NaN or infinite components are left out; vectors of several lengths, or
    of one that 16 doesn't divide, are filled up with zeros; components beyond 2 ** 24 count as that; empty vectors are
    zeros. Rows of null key come last, rows that repeat a key are coded each, in the order of their components. Fewer
    rows than 64 make as many entries. Null labels are one label. A sum of errors beyond 64 bits is the largest long.
    An empty table gives an empty result; columns other than the three, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    rows = scratch.save(integers(vectors, key, column, label), "rows")
    longest = rows.agg(F.max(F.size("_ints"))).first()[0]
    size = PARTS * max(1, -(-(longest or 0) // PARTS))
    width = size // PARTS
    first = rows.orderBy(F.col("_key").asc_nulls_last(), "_ints").limit(ENTRIES).select("_ints").collect()
    start = np.zeros((len(first), size), dtype=np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["_ints"])] = r["_ints"]
    book = np.ascontiguousarray(start.reshape(len(first), PARTS, width).transpose(1, 0, 2))
    for _ in range(ROUNDS):
        sums = _sums(rows, Cells(book), size)
        book = book.copy()
        for (p, e, j), value in sums.items():
            if j >= 0:
                book[p, e, j] = value // sums[p, e, -1]
    cells = Cells(book)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    schema = StructType([rows.schema["_key"], rows.schema["_label"], *StructType.fromDDL("code string, error long").fields])
    arrow = to_arrow_schema(schema)
    pairs = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, BATCH) for whole in batches for at in range(0, whole.num_rows, BATCH)):
            index, far = cells.assign(_matrix(batch.column(2), size))
            code = ["".join(row) for row in pairs[index].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, type=pa.string()), pa.array(far.sum(axis=1))], schema=arrow)

    found = scratch.save(rows.select("_key", "_label", "_ints").mapInArrow(tidy(coded), schema), "coded")
    scratch.drop("rows")
    largest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    errors = scratch.save(found.groupBy(F.col("_label").alias("_of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), largest).cast("long").alias("label_error")), "errors", light=True)
    side = F.broadcast(errors) if errors.count() <= MOST_BROADCAST else errors
    joined = found.join(side, F.col("_label").eqNullSafe(F.col("_of")))
    return joined.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, width: int = 4) -> str:
    """The same over vectors of 64 components, by comparing every part with every entry."""
    far = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    rounds = ""
    for k in range(ROUNDS + 1):
        rounds += f"""
, near{k} AS (SELECT x.vec_id, x.label, x.p, arg_min(b.e, {far} * {entries} + b.e) AS e, min({far}) AS far
  FROM parts x JOIN book{k} b ON x.p = b.p GROUP BY x.vec_id, x.label, x.p)"""
        if k < ROUNDS:
            means = ", ".join(f"CAST((sum(x.v[{j}]) - (sum(x.v[{j}]) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT)" for j in range(1, width + 1))
            rounds += f"""
, book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
  SELECT n.p, n.e, [{means}] AS v FROM near{k} n JOIN parts x ON n.vec_id = x.vec_id AND n.p = x.p GROUP BY n.p, n.e) m ON m.p = b.p AND m.e = b.e)"""
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
, parts AS (SELECT vec_id, label, p, v[{width} * p + 1 : {width} * (p + 1)] AS v FROM kept, range({parts}) t(p))
, book0 AS (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {entries})
{rounds}
, digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
, coded AS (SELECT vec_id, label, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""


ORACLE = _oracle()
