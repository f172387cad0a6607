"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is the smallest node reachable.

    Each step is two shuffles with a minimum that is combined before the shuffle; every step is written, so lost
    executors repeat one step at most. An empty edge table gives an empty result. Self-loops and repeated edges are
    allowed, null ends are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = scratch.save(e, f"{name}_0")
    before, k = None, 0
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before, k = now, k + 1
        # large star: what is larger than u goes to the smallest neighbour of u
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}_{k}l")
        # small star: what is smaller than u goes to the smallest of it, and so does u
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        e = scratch.save(small, f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}", f"{name}_{k}l")
