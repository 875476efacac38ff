"""Mixing sources to target weights with hash-threshold histograms. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
#: A row's place in its source's order is a 48-bit hash, refined LEVELS times by BITS bits.
LEVELS, BITS = 4, 12


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column) -> Column:
    """48 bits of the key's MD5, so that the order can be had in any engine; a null key counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, LEVELS * BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Targets of (source, source_size): `share` of all sizes by weight, none above `cap` times its source's size.

    What a cap cuts off is shared again by weight among the others until none is above its cap. In the order of
    cap / weight, the sources that reach their caps come first, so one running sum finds them all. The table has one
    row a source; they are gathered for their order by name and for that sum alone, all other sums are aggregates.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    whole = ranked.agg((F.sum("source_size") * F.lit(float(share))).alias("wanted"), F.sum("weight").alias("all_weights"))
    level = (F.col("wanted") - F.coalesce(F.sum("most").over(before), zero)) / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), zero))
    leveled = ranked.join(F.broadcast(whole)).withColumn("capped", F.col("ratio") <= level)
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))), zero)
    left = leveled.agg((F.first("wanted") - kept("most")).alias("left"), (F.first("all_weights") - kept("weight")).alias("left_weights"))
    shared = F.col("weight") * F.try_divide(F.col("left"), F.col("left_weights"))
    return leveled.join(F.broadcast(left)).select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, key: str = "doc_id") -> DataFrame:
    """How many words of each row a mix of sources takes.

    Columns: key, source, size (words), source_size, target (the source's), taken. A source is taken whole as many
    times as it fits in its target; the rest of the target goes to the rows whose key hashes lowest. The threshold is
    found by histogram: words by source and hash bucket, then again inside the one bucket where the budget ends, until
    the bucket is one hash value. That row gives only the words that are left, so a source's taken words are its
    target's whole part; rows with one hash (repeated keys) share what is left in proportion to their size.

    Null or empty texts have size 0 and give 0; null sources are one source, last in order; a very long text counts like
    any other, in one pass; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized, plan = _planned(docs, scratch, weights, share, cap, key)
    rows = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    taken = F.col("passes") * F.col("size") + _part()
    return scratch.only(rows.select(key, "d.source", "size", "source_size", "target", taken.cast("long").alias("taken")))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, key: str = "doc_id") -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with the columns of docs. The row in which a source's
    budget ends is taken once more when at least half of it is left. Rows without words come as often as their
    source is taken whole."""
    _, plan = _planned(docs, Scratch(docs.sparkSession, "mix"), weights, share, cap, key)
    plan = plan.select(F.col("source").alias("_source"), "passes", "left", "bucket", "tied")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").alias("_of"), word_count("text").alias("size"), place(F.col(key)).alias("at"))
    rows = rows.join(plan, F.col("_of").eqNullSafe(F.col("_source")))
    times = F.col("passes") + F.when((_part() > 0) & (2 * _part() >= F.col("size")), 1).otherwise(0)
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_copy")).select("_row.*")


def _part() -> Column:
    """Words that the last, partial pass takes of a row."""
    part = F.when(F.col("at") < F.col("bucket"), F.col("size")).when(F.col("at") > F.col("bucket"), F.lit(0))
    return F.coalesce(part.otherwise(F.floor(F.try_divide(F.col("size").cast("decimal(19,0)") * F.col("left"), F.col("tied"))).cast("long")), F.lit(0))


def _planned(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...], share: float, cap: float, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows' sizes and places, and for each source its target, whole passes, and the threshold of the last one."""
    sized = scratch.save(docs.select(F.col(key), F.col("source"), word_count("text").alias("size"), place(F.col(key)).alias("at")), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (
        source_targets(sizes, weights, share, cap)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.floor("target").cast("long") - F.col("passes") * F.col("source_size"))
        .withColumn("bucket", F.lit(0).cast("long"))
    )
    plan = scratch.save(plan.withColumn("tied", F.col("source_size")), "plan0")
    for level in range(1, LEVELS + 1):
        plan = scratch.save(_refined(sized, plan, level), f"plan{level}")
    return sized, plan


def _refined(sized: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """The plan with each source's boundary bucket narrowed by BITS bits, and what is left of its budget in there."""
    below = (LEVELS - level) * BITS
    inside = sized.alias("d").join(
        plan.select("source", F.col("bucket").alias("outer")).alias("p"),
        F.col("d.source").eqNullSafe(F.col("p.source")) & (F.shiftright("at", below + BITS) == F.col("outer")),
    )
    histogram = inside.groupBy("d.source", F.shiftright("at", below).alias("inner")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("inner")
    running = histogram.withColumn("through", F.sum("words").over(upto)).withColumn("before", F.col("through") - F.col("words"))
    joined = plan.alias("p").join(
        running.alias("h"),
        F.col("p.source").eqNullSafe(F.col("h.source")) & (F.col("before") <= F.col("left")) & (F.col("left") < F.col("through")),
        "left",
    )
    return joined.select(
        "p.source", "source_size", "target", "passes",
        (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"),
        F.coalesce("inner", F.shiftleft("bucket", BITS)).alias("bucket"),
        F.coalesce("words", F.lit(0)).alias("tied"),
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS spot
  FROM documents
), sizes AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
         (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight
  FROM sizes
), leveled AS (
  SELECT *, most / weight AS ratio, 1.5::DOUBLE * SUM(source_size) OVER () AS wanted, SUM(weight) OVER () AS all_weights,
         COALESCE(SUM(most) OVER w, 0) AS most_before, COALESCE(SUM(weight) OVER w, 0) AS weight_before
  FROM ranked WINDOW w AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, ratio <= (wanted - most_before) / (all_weights - weight_before) AS capped FROM leveled
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN most ELSE weight * (wanted - COALESCE(SUM(most) FILTER (capped) OVER (), 0))
         / NULLIF(all_weights - COALESCE(SUM(weight) FILTER (capped) OVER (), 0), 0) END AS target
  FROM capped
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM targets
), ordered AS (
  SELECT d.*, p.source_size, p.target, p.passes, floor(p.target)::BIGINT - p.passes * p.source_size AS budget,
         SUM(size) OVER (PARTITION BY d.source, spot) AS tied,
         SUM(size) OVER (PARTITION BY d.source ORDER BY spot RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
  FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size, source_size, target,
       (passes * size + CASE WHEN through <= budget THEN size WHEN through - tied >= budget THEN 0
        ELSE (size::HUGEINT * (budget - (through - tied)) // tied) END)::BIGINT AS taken
FROM ordered
"""
