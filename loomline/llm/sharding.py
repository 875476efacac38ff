"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split further."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .mixing import BITS, LEVELS, place

SHARD_BYTES = 1 << 20
_SHARD = ("depth", "prefix", "shard_bytes", "shard_docs")


def _at() -> Column:
    """A row's place: 48 bits of the MD5 of its key and text."""
    return place(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def directory(histogram: DataFrame, level: int, limit: int) -> DataFrame:
    """bucket and shard (null where even the bucket is too large) from sizes by the first level * BITS hash bits.

    A bucket's shard is its shortest prefix whose rows fit the limit, or have one hash and so can't be split. Shorter
    prefixes than those of this level's parent buckets are known to be too large.
    """
    depths = F.sequence(F.lit(0 if level == 1 else (level - 1) * BITS + 1), F.lit(level * BITS))
    every = histogram.withColumn("depth", F.explode(depths)).withColumn("prefix", F.expr(f"shiftright(bucket, {level * BITS} - depth)"))
    group = Window.partitionBy("depth", "prefix")
    for name, f, column in (("shard_bytes", F.sum, "bytes"), ("shard_docs", F.sum, "docs"), ("low", F.min, "least"), ("high", F.max, "most")):
        every = every.withColumn(name, f(column).over(group))
    fits = (F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))
    return every.groupBy("bucket").agg(F.min(F.when(fits, F.struct(*_SHARD))).alias("shard"))


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, depth, prefix, shard_bytes, shard_docs of each row; a shard is a (depth, prefix).

    Rows are placed by 48 bits of the MD5 of doc_id and text. The directory grows by BITS bits at a time, for the
    oversized buckets alone: their rows are summed up by the next bits, in partial sums before the shuffle, and
    prefixes in between are tried first, so each shard has as few bits as fit. The directory has some four
    entries a shard; rows are joined with it by equality, and not shuffled where it is small.

    Every shard fits the limit but those that can't be split: a text that is larger by itself, or repeats of one row.
    Null texts have 0 bytes, null keys count as empty; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    sized = scratch.save(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), _at().alias("at")), "sized")
    rows, inside = sized, sized
    found = []
    for level in range(1, LEVELS + 1):
        bucket = F.shiftright("at", (LEVELS - level) * BITS)
        sums = inside.groupBy(bucket.alias("bucket")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("at").alias("least"), F.max("at").alias("most"))
        entries = scratch.save(directory(sums, level, limit), f"level{level}")
        name = f"shard{level}"
        rows = rows.join(entries.select(F.col("bucket").alias(f"b{level}"), F.col("shard").alias(name)), bucket == F.col(f"b{level}"), "left").drop(f"b{level}")
        found.append(F.col(name))
        open_ = entries.where("shard is null").select(F.col("bucket").alias("open"))
        if open_.isEmpty():
            break
        inside = sized.join(open_, bucket == F.col("open"), "left_semi")
    return scratch.only(rows.select("doc_id", "n_bytes", F.coalesce(*found).alias("s")).select("doc_id", "n_bytes", *[F.col(f"s.{c}") for c in _SHARD]))


def write_shards(docs: DataFrame, folder: str, limit: int = SHARD_BYTES) -> None:
    """Writes the rows, one folder a shard, named by its bits after a 'b'. A row tries the depths that occur."""
    shards = Scratch(docs.sparkSession, "shards").save(assign(docs, limit).select("depth", "prefix").distinct(), "directory")
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())
    options = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright(_at(), LEVELS * BITS - d).alias("prefix")) for d in depths or [0]])
    tried = docs.select(F.struct("*").alias("_row"), F.explode(options).alias("_o")).select("_row", "_o.*").join(shards, ["depth", "prefix"])
    bits = F.when(F.col("depth") > 0, F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))).otherwise("")
    tried.select("_row.*", F.concat(F.lit("b"), bits).alias("shard")).repartition("shard").write.partitionBy("shard").parquet(folder)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, COALESCE(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '') || ':' || COALESCE(text, '')), 1, 12))::BIGINT AS spot
  FROM documents
), d AS (
  SELECT t.*, depth::INT AS depth, spot >> (48 - depth)::INT AS prefix FROM t, range(49) r(depth)
), s AS (
  SELECT *, SUM(n_bytes) OVER w::BIGINT AS shard_bytes, COUNT(*) OVER w AS shard_docs, MIN(spot) OVER w = MAX(spot) OVER w AS one FROM d WINDOW w AS (PARTITION BY depth, prefix)
)
SELECT doc_id, n_bytes, depth, prefix, shard_bytes, shard_docs FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS r FROM s WHERE shard_bytes <= 1048576 OR one
) WHERE r = 1
"""
