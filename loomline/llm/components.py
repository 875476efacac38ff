"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the least node reachable) of every node that occurs in `links` (a, b: long).

    Alternating large-star and small-star steps: every node hands its larger, then its smaller neighbours to the least
    of its neighbourhood, until the links no longer change. The number of steps grows with the logarithm of the
    longest path. Only a count and a checksum reach the driver. Each pair of
    steps is written to the shared folder.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0", light=True)
    before, step = None, 0
    while True:
        step += 1
        starred = edges
        for large in (True, False):
            around = starred.unionByName(starred.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else starred
            least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            # every node hands on its neighbours (large: the larger ones), and in a small step itself
            handed = around.join(least, "u").where("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
            if not large:
                handed = handed.unionByName(least.select("u", F.col("m").alias("v")))
            starred = handed.where("u <> v").distinct()
        edges = scratch.save(starred, f"{name}-{step}", light=True)
        scratch.drop(f"{name}-{step - 1}")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
